"""Item rows from the lines of a section: a state machine as an ordered table of rules, one group a section of a document.

A rule is (states, predicate, action); the first whose predicate holds for a line acts on it. Rules are data, so they can
be read and tested one by one. The unit of work is one section of one document, in the order of its lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import KNOWN_UNITS, NOT_UNITS
from ..session import ship

# The grammar of item codes, suffix marks included, and lines that never belong to an item.
MARKS = r"(?:-\d+)?(?:[#>*@%^+]|\s?\[\d*\]|[\[\]]\d*)?(?:ASIM|TSCH)?-?"
NORMATIVE = r"[A-Z]{2,5}\d{1,2}[A-Z]{1,3}\d{1,4}[A-Z]?\d?|[A-Z]{1,5}\d{1,4}[A-Z]?\d{0,2}[A-Z]?\d?|[A-Z]\d[A-Z]{1,3}\d{2,4}[A-Z]?\d{0,2}|[A-Z]\d{2,3}[A-Z]\d{2}"
MIXED = r"\d{3,5}[A-Z]\d{1,3}(?!\d)"
NUMERIC = r"\d{4,9}(?!\d)"
CODE = rf"(?:{NORMATIVE}|{MIXED}|\$?{NUMERIC}|\$[A-Z0-9]{{4,}})"
I = re.IGNORECASE
DESCRIBED = re.compile(rf"^({CODE})({MARKS})\s*[-–]\s*(.+)$", I)
ALONE = re.compile(rf"^({NORMATIVE}|{MIXED}|\$[A-Z0-9]{{4,}})({MARKS})((?:\s+[A-Z]{{1,8}}\.?){{0,3}})\s*$", I)
NUMBERED = re.compile(rf"^(\d{{1,3}})[\s|]+({CODE})({MARKS})\s*[-–]\s*(.+)$", I)
NUMBERED_ALONE = re.compile(rf"^(\d{{1,3}})[\s|]+({CODE})({MARKS})((?:\s+[A-Z]{{1,8}}\.?){{0,2}})\s*$", I)
GLUED = re.compile(rf"^(\d{{1,3}})((?:{NORMATIVE}))({MARKS})\s*[-–]\s*(.+)$", I)
PIPED = re.compile(r"^(\d{4,9})(?!\d)(?:\[\d+\])?\s+(@?[^|]{3,}?)(?:\s*\|([A-Z]{1,6}\.?))?\s*$")
ROW_NUMBER = re.compile(r"^\d{1,3}$")
LINKED = re.compile(r"^(?:(\d{1,3})(?:\.\d+)?)?\.L\s*$", I)
LINK = re.compile(r"^L\s*$", I)
PREFIXED = re.compile(r"^L\s*:\s*[A-Z0-9]+\s*-\s*[A-Z0-9]*\s*:\s*([0-9A-Z]+)\s*[-–]?\s*(.*)$", I)
SUB_ROW = re.compile(r"^\d{1,3}\.\d$")
BARE_NUMBER = re.compile(r"^\d{4,9}$")
DECIMAL = re.compile(r"^-?(?:\d{1,10}(?:[.,]\d{3})*[.,]\d{1,6}|\d{1,10}[.,]\d{1,3})$")
INTEGER = re.compile(r"^-?\d{1,6}$")
NUMBER = re.compile(r"^[\d.,]+$")
FIGURE = re.compile(r"[0-9.,]+")
LABEL = re.compile(r"^(?:material|manopera|utilaj|transport)\s*:", I)
COMPONENT = re.compile(r">>>\s*component[a-z]?\b", I)
SPEC = re.compile(r"^(?:[A-Z]{1,2}\d{2}|[A-Z]\d{3,5})$", I)
MODEL = re.compile(r"^[A-Z]{2,3}\d{2,4}$", I)
# Lines that never belong to an item.
SKIPPED = (
    r"Cheltuieli\s+directe", r"Total\s+cheltuieli", r"Cheltuieli\s+indirecte", r"Profit", r"TOTAL\s+GENERAL", r"TVA", r"contributie\s+asiguratorie",
    r"Formular\s+generat\s+cu\s+programul", r"Pagina\s+\d+\s+din\s+\d+", r"Deviz\s+[\"']?\d+(?:\.\d+)?[\"']?\s*[-–]?\s*Formular\s+F3", r"^\d+\s+pag", r"^pag\s", r"\bpag$",
    r"Lista\s+cu\s+cantitati", r"Categoria\s+de\s+lucrari", r"Persoana\s+juridica", r"Obiectul\s*:", r"^Deviz\s+oferta", r"^=\s*$", r"^NR\.\s+SIMBOL", r"^CANTITATE$", r"^PU\s", r"^GR\.\s+", r"^SPOR\s",
    r"^(MATERIALE|MANOPERA|UTILAJ|TRANSPORT|GREUTATE|TOTAL|ARTICOL)$", r"^\d{4,8}$", r"Din\s+care:", r"Valoare\s+aferenta", r"PROIECTANT", r"ORIGEN\s+STUDIE", r"SIGN\s+", r"S\.\s+C\.\s+", r"-\s+proiect",
    r"STE[\-\s]", r"\d{3}-?rev[/\s]+\d{4}", r"(?:proiect|project)\s+(?:initial|inițial|integral|actualizat|updated)", r"-\s+(?:proiect|project)",
)
#: What an ASCII line that begins with no digit must hold, in lower case, for one of SKIPPED to match.
SKIP_WORDS = (
    "cheltuieli", "profit", "general", "tva", "contributie", "formular", "pag", "deviz", "lista", "categoria", "persoana", "obiectul", "=", "simbol", "cantitate", "pu", "gr.", "spor", "material", "manopera", "utilaj", "transport",
    "greutate", "total", "articol", "care:", "aferenta", "proiect", "project", "origen", "sign", "s.", "ste", "rev",
)
#: Company names (fixed values). They try many beginnings in a line, so they are tried only where one of these words stands.
COMPANIES = (r"[A-Z\s]*S\.R\.L\.", r"[A-Z]{2,}\s+SRL", r"(?:design|studio|solutions?)(?:\s+|\.)*s\.?r\.?l\.?")
COMPANY_WORDS = ("s.r.l", "srl", "s.rl", "sr.l")
#: Names and project numbers of one customer (fixed values): a line that holds one belongs to no item. Other customers pass their own to parse().
SITE = ("Artisan", "424", "TARGO", "DAMBO")
#: Where an item of this section's number ends: its page's footer.
SECTION_FOOTER = re.compile(r"deviz\s+['\"]?\d{5,8}['\"]?\s*[-–]?\s*formular\s+f3", I)
FOOTER = re.compile(r"^pag|formular\s+f3|e\s+devize", I)
#: Units of time, which resources have (fixed values).
TIMES = ("ORA", "ORE", "ZI", "ZILE", "SCHIMB", "LUNA", "LUNI", "SAPT")
PRICES = tuple(f"{a}_{b}" for b in ("material", "manopera", "utilaj", "transport") for a in ("pret", "val"))
COLUMNS = "doc_id string, seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean, parent_code string, subcomponents array<string>, " + ", ".join(f"{p} double" for p in PRICES)


@lru_cache(maxsize=8)
def _skips(site: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What skips a line, that with company names, and what of it can skip a line of digits, points and commas."""
    plain, marks = (*SKIPPED, *map(re.escape, site)), [re.escape(x) for x in site]
    return re.compile("|".join(plain), I), re.compile("|".join((*plain, *COMPANIES)), I), re.compile("|".join((r"^\d{4,8}$", *marks)), I)


@lru_cache(maxsize=8)
def _skip_words(site: tuple[str, ...]) -> tuple[str, ...]:
    """SKIP_WORDS and what company names and a customer's marks hold; a mark that isn't ASCII is found by its pattern."""
    return (*SKIP_WORDS, *COMPANY_WORDS, *(x.lower() if x.isascii() else "" for x in site))


@lru_cache(maxsize=1 << 16)
def skipped(line: str, site: tuple[str, ...] = SITE) -> bool:
    """Whether a line belongs to no item."""
    plain, every, _ = _skips(site)
    low = line.lower()
    if line.isascii() and not line[:1].isdigit() and not any(w in low for w in _skip_words(site)):
        return False
    return bool((every if any(w in low for w in COMPANY_WORDS) else plain).search(line))


def skipped_figure(line: str, site: tuple[str, ...] = SITE) -> bool:
    """skipped() for a line of digits, points and commas. Such lines seldom repeat, so they are not remembered."""
    return bool(_skips(site)[2].search(line))


def number(s: str) -> float:
    s = s.strip().replace(" ", "")
    if "." in s and "," in s:
        s = s.replace(".", "").replace(",", ".") if s.index(".") < s.index(",") else s.replace(",", "")
    try:
        return float(s.replace(",", "."))
    except ValueError:
        return 0.0


@lru_cache(maxsize=1 << 16)
def unit(token: str) -> str | None:
    """The unit that a token stands for, None if it is none."""
    low, t = token.lower().strip(), re.sub(r"[.\s]", "", token).upper()
    if low in ("m cub", "m3", "m cu b"):
        return "mc"
    if low in ("m²", "m2", "mp"):
        return "mp"
    if "m²" in low or "m2" in low:
        return t.lower()
    if not t or t in NOT_UNITS or re.search(r"\d", token):
        return None
    quiet = re.sub(r"[?!|~^]", "", t)
    if quiet not in KNOWN_UNITS:
        return None
    return {"BUCATA": "buc", "BUCAT": "buc", "TONE": "tona", "ORE": "ora", "OREI": "ora"}.get(quiet, quiet.lower())


@dataclass
class Item:
    code: str = ""
    parts: list[str] = field(default_factory=list)
    um: str = ""
    quantity: float = 0.0
    prices: list[float] = field(default_factory=list)
    component: bool = False
    linked: bool = False


class Machine:
    """The state: idle, waiting for a code after a row number, or reading an item."""

    def __init__(self, site: tuple[str, ...] = SITE):
        self.site = site
        self.out: list[dict] = []
        self.item: Item | None = None
        self.waiting = 0
        self.linked = self.marked = False
        self.last_number = 0
        self.parent = self.line = self.next = ""

    @property
    def state(self) -> str:
        return "read" if self.item else "wait" if self.waiting else "idle"

    def flush(self) -> None:
        it, self.item = self.item, None
        if it is None or not it.code:
            return
        code, text = it.code.upper(), re.sub(r"\s+", " ", " ".join(it.parts)).strip()
        if code.isdigit():
            code = "$" + code
        summary = re.fullmatch(r"\$\d{4,7}", code) and FOOTER.search(text)
        if "/" in code or code in KNOWN_UNITS or SPEC.match(code) or re.fullmatch(r"\$0{2,}\d", code) or summary or SECTION_FOOTER.search(text):
            return
        um = "mc" if it.um == "m" and "cub" in text.lower() else it.um
        part = it.component or (bool(self.parent) and component_mark(code, self.parent, text))
        self.out.append({"cod": code, "denumire": text, "um": um, "cantitate": it.quantity, "is_component": part, "parent_code": (self.parent or None) if part else None, "subcomponents": [m.upper() for m in re.findall(r"L\s*:\s*[A-Z0-9]+\s*-\s*[A-Z0-9]*\s*:\s*([0-9A-Z]+)", text, I)], **{p: (it.prices[i] if i < len(it.prices) else 0.0) for i, p in enumerate(PRICES)}})
        if not part:
            self.parent = code

    def start(self, code: str, text: str = "", tokens: str = "") -> None:
        """Opens an item; its code loses variant numbers and the marks at its end."""
        self.flush()
        code = re.sub(r"-\d+[#@!]*$", "", code)
        self.item = Item(re.sub(r"(?:ASIM|TSCH)$", "", code, flags=I), [text.strip()] if text.strip() else [], component=self.marked)
        self.waiting, self.linked, self.marked = 0, False, False
        for t in tokens.split():
            if unit(t):
                self.item.um = unit(t)

    def wait(self, linked: bool = False) -> None:
        self.flush()
        self.waiting, self.linked = 1, linked


def component_mark(code: str, last: str, line: str) -> bool:
    """Whether a code is a component of the last item: a marker, `.L` at its end, `N.M` after `N`, the prefix `L:`, or a price heading."""
    nested = re.fullmatch(r"(\d+)\.\d+", code)
    return bool(COMPONENT.search(line) or re.search(r"\.L$", code, I) or (nested and nested[1] == last) or re.match(r"\s*L:\s*[A-Z0-9]+\s+-", line) or re.search(r"(?:material|manopera|utilaj|transport):\s*$", line, I))


def _complete(m: Machine) -> bool:
    return bool(m.item and (m.item.um or m.item.quantity))


def _is_row_number(m: Machine, line: str) -> bool:
    it, n = m.item, int(line)
    full = len(it.prices) >= 4 or (it.quantity > 0 and (len(it.prices) >= 2 or not it.prices))
    return 1 <= n <= 999 and full and (n >= m.last_number or n <= 5)


def _row(m: Machine, line: str) -> None:
    m.wait()
    m.last_number = int(line)


def _quantity(m: Machine, line: str) -> None:
    m.item.quantity = number(line)


def _numbered(m: Machine, line: str) -> None:
    g = NUMBERED.match(line)
    m.start(g[2], g[4])
    m.last_number = int(g[1])


def _numbered_alone(m: Machine, line: str) -> None:
    g = NUMBERED_ALONE.match(line)
    m.start(g[2], "", g[4] or "")
    m.last_number = int(g[1])


def _glued(m: Machine, line: str) -> None:
    g = GLUED.match(line)
    m.start(g[2], g[4])
    m.last_number = int(g[1])


def _described(m: Machine, line: str) -> None:
    g = DESCRIBED.match(line)
    m.start(g[1], g[3])


def _alone(m: Machine, line: str) -> None:
    g = ALONE.match(line)
    m.start(g[1], "", g[3] or "")


def _piped(m: Machine, line: str) -> None:
    g = PIPED.match(line)
    m.start(g[1], g[2], g[3] or "")


def _prefixed(m: Machine, line: str) -> None:
    g = PREFIXED.match(line)
    m.start(g[1], g[2])
    m.item.component = True


def _linked(m: Machine, line: str) -> None:
    g = LINKED.match(line)
    m.wait(True)
    m.last_number = int(g[1]) if g and g[1] else m.last_number or 1


def _wait_more(m: Machine, line: str) -> None:
    m.waiting = 0 if m.waiting >= 3 else m.waiting + 1


def _mark(m: Machine, line: str) -> None:
    m.marked = bool(COMPONENT.search(line))


def _unit(m: Machine, line: str) -> None:
    m.item.um = unit(line)


def _unit_row(m: Machine, line: str) -> None:
    u, q, t = (x.strip() for x in line.split("|", 2))
    m.item.um, m.item.quantity = unit(u), number(q)
    if t:
        m.item.parts.append(t)


def _count_unit(m: Machine, line: str) -> None:
    words = line.split()
    m.item.um = unit(" ".join(words[1:3])) or unit(words[-1]) or unit(words[1]) or "m"


def _weak(m: Machine, line: str) -> bool:
    """A code on an item that has neither unit nor quantity is rather part of its description."""
    g = DESCRIBED.match(line) or ALONE.match(line)
    return not _complete(m) and bool(g) and (g.re is ALONE and bool(SPEC.match(g[1]) or len(g[1]) < 5) or g.re is DESCRIBED and len(g[3]) < 3)


def _fit(line: str) -> bool:
    """A code and a description of its own: a letter code with less than three characters behind it is part of a name."""
    g = DESCRIBED.match(line)
    if g and not g[1][0].isdigit() and not g[1].startswith("$") and len(g[3].strip()) < 3:
        return False
    return bool(g) and not (g[1].isdigit() and not re.search(r"[A-Za-z]{2}", g[3])) and not SPEC.match(g[1]) and not unit(g[1])


def _is_size(m: Machine, line: str) -> bool:
    """A bare number before a unit whose next line is a decimal, a fraction or a short word that is no unit: a size, not a row."""
    after = m.next
    if not (m.item and not m.item.um and ROW_NUMBER.match(line)):
        return False
    short = re.match(r"^[A-Z]{1,4}[\"'°%]?\s*$", after, I) and after.upper() not in KNOWN_UNITS
    return bool(DECIMAL.match(after) or re.match(r"^\d+/\d+", after) or short)


def _before_unit(m: Machine, line: str) -> bool:
    """A unit of one letter whose next line is a unit too."""
    return len(re.sub(r"[.\s]", "", line)) == 1 and unit(m.next) is not None


def _decimal_after(m: Machine, line: str) -> bool:
    return bool(SUB_ROW.match(line)) and (m.item is None or m.item.quantity > 0)


RULES = [
    ("read", lambda m, s: LABEL.match(s), lambda m, s: None),
    ("idle wait read", lambda m, s: not s or ((skipped_figure if FIGURE.fullmatch(s) else skipped)(s, m.site) and not (m.state == "wait" and m.linked and BARE_NUMBER.match(s))) or LABEL.match(s), lambda m, s: None),
    ("idle wait read", lambda m, s: LINKED.match(s), _linked),
    ("idle wait read", lambda m, s: LINK.match(s) and not (m.item and not m.item.um), lambda m, s: _linked(m, ".L")),
    ("idle wait read", lambda m, s: PREFIXED.match(s), _prefixed),
    ("idle wait read", lambda m, s: _decimal_after(m, s) and not (m.item and m.item.prices), lambda m, s: m.wait()),
    ("idle wait read", lambda m, s: s.startswith(">>>"), _mark),
    ("idle wait read", lambda m, s: NUMBERED.match(s), _numbered),
    ("idle wait", lambda m, s: NUMBERED_ALONE.match(s), _numbered_alone),
    ("read", lambda m, s: NUMBERED_ALONE.match(s) and _complete(m), _numbered_alone),
    ("idle wait", lambda m, s: ROW_NUMBER.match(s), _row),
    ("idle wait read", lambda m, s: GLUED.match(s) and (m.item is None or _complete(m)), _glued),
    ("wait", lambda m, s: m.linked and BARE_NUMBER.match(s), lambda m, s: m.start("$" + s)),
    ("idle wait", lambda m, s: _fit(s), _described),
    ("wait", lambda m, s: ALONE.match(s) and not unit(s), _alone),
    ("idle", lambda m, s: ALONE.match(s) and not unit(s) and not SPEC.match(ALONE.match(s)[1]), _alone),
    ("idle wait", lambda m, s: PIPED.match(s) and "|" in s, _piped),
    ("wait", lambda m, s: True, _wait_more),
    ("idle", lambda m, s: True, lambda m, s: None),
    ("read", lambda m, s: MODEL.match(s) and not _complete(m), lambda m, s: None),
    ("read", lambda m, s: _is_size(m, s), lambda m, s: m.item.parts.append(s)),
    ("read", lambda m, s: ROW_NUMBER.match(s) and m.item.quantity and _is_row_number(m, s), _row),
    ("read", lambda m, s: _fit(s) and not _weak(m, s), _described),
    ("read", lambda m, s: ALONE.match(s) and not unit(s) and _complete(m) and not SPEC.match(ALONE.match(s)[1]), _alone),
    ("read", lambda m, s: not m.item.um and unit(s) and (unit(s) == "km" or _before_unit(m, s)), lambda m, s: None),
    ("read", lambda m, s: not m.item.um and unit(s), _unit),
    ("read", lambda m, s: not m.item.um and re.match(r"^\d+\s+(?:KM|[A-Z])\.?\s*$", s, I) and (s.upper().rstrip(" .").endswith("KM") or (unit(s.split()[1]) and unit(m.next))), lambda m, s: None),
    ("read", lambda m, s: not m.item.um and re.match(r"^(?:ZECI|SUTE)\s+\S+$", s, I), _count_unit),
    ("read", lambda m, s: not m.item.um and re.match(r"^\d+\s+[A-Za-z]+(?:\s+[A-Za-z]+)?$", s) and (unit(s.split(None, 1)[1]) or unit(s.split()[-1])), _count_unit),
    ("read", lambda m, s: not m.item.um and s.count("|") >= 1 and unit(s.split("|")[0]) and DECIMAL.match(s.split("|")[1].strip()), lambda m, s: _unit_row(m, s + "|")),
    ("read", lambda m, s: not m.item.quantity and DECIMAL.match(s), _quantity),
    ("read", lambda m, s: not m.item.quantity and m.item.um and INTEGER.match(s), _quantity),
    ("read", lambda m, s: m.item.quantity and m.item.um and s == "000", lambda m, s: setattr(m.item, "quantity", float(int(m.item.quantity)))),
    ("read", lambda m, s: NUMBER.match(s), lambda m, s: m.item.prices.append(number(s)) if _complete(m) else None),
    ("read", lambda m, s: not m.item.um or not re.search(r"^\s*\d+[.,]\d{2}\s*$|RON|EUR|USD|€", s), lambda m, s: m.item.parts.append(s) if not (m.item.prices) else None),
    ("read", lambda m, s: True, lambda m, s: None),
]
RULES = [(frozenset(states.split()), test, act) for states, test, act in RULES]
#: Places of the rules that can act on a line of digits, points and commas: the others ask for a letter, a space or another mark.
FIGURES = frozenset((1, 5, 10, 12, 17, 18, 20, 21, 30, 31, 32, 33, 34, 35))
#: By state, the rules that can act in it on any line, and on one of digits, points and commas.
BY_STATE = {state: ([r for r in RULES if state in r[0]], [r for i, r in enumerate(RULES) if state in r[0] and i in FIGURES]) for state in ("idle", "wait", "read")}


# What stands for a unit and a quantity in records that OCR scattered over lines, and what begins another item. A code stands alone there.
LONE_CODE = re.compile(rf"^(?:{CODE}){MARKS}$", I)
BEGINS = re.compile(r"^(?:[A-Z]{1,5}\d{1,4}|\$[A-Z0-9]{4,}|\d{4,9}(?!\d))", I)
SCATTERED_UNIT, SCATTERED_QUANTITY, COUNTER = re.compile(r"^[A-Za-z\s.]{1,19}$"), re.compile(r"^[\d.,]+$"), re.compile(r"^\d+$")


TORN, DIGITS = re.compile(rf"^[A-Z]{{2,5}}\d{{1,2}}[A-Z]{{2,4}}{MARKS}$", I), re.compile(r"^\d{1,2}$")
COUNT, WORD = re.compile(r"^\d{1,4}$"), re.compile(r"^[A-Za-z]{1,6}\.?$")


def _scattered(lines: list[str], i: int, site: tuple[str, ...]) -> tuple[list[str], int] | None:
    """The lines that a record scattered from line i on becomes, and where it ends; None where none begins: a counter, a code, a unit, a quantity, then text up to what begins another item or belongs to none."""
    if i + 3 >= len(lines) or not (COUNTER.match(lines[i]) and LONE_CODE.match(lines[i + 1]) and SCATTERED_UNIT.match(lines[i + 2]) and SCATTERED_QUANTITY.match(lines[i + 3])):
        return None
    j = i + 4
    while j < len(lines) and not (COUNTER.match(lines[j]) or BEGINS.match(lines[j]) or LABEL.match(lines[j]) or (lines[j] and skipped(lines[j], site))):
        j += 1
    told = " ".join(x for x in lines[i + 4 : j] if x)
    return ([f"{lines[i]} {lines[i + 1]} - {told}", lines[i + 2], lines[i + 3]], j) if told else None


def merged(lines: list[str], site: tuple[str, ...] = SITE) -> list[str]:
    """Joins what OCR tore: a record scattered over lines, a code and its last digits, a number of up to four digits and the unit behind it."""
    lines, out, i = [s.strip() for s in lines], [], 0
    while i < len(lines):
        s, after = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        found = _scattered(lines, i, site)
        if found:
            out += found[0]
            i = found[1]
        elif TORN.match(s) and DIGITS.match(after):
            out.append(s + after)
            i += 2
        elif COUNT.match(s) and WORD.match(after) and after.rstrip(".").upper() in KNOWN_UNITS and after.rstrip(".").upper() != "KM":
            out.append(f"{s} {after}")
            i += 2
        else:
            out.append(s)
            i += 1
    return out


def parse_lines(lines: list[str], site: tuple[str, ...] = SITE, m: Machine | None = None) -> list[dict]:
    """The items of one section's lines, in order; a machine that read the lines before goes on."""
    m = m or Machine(site)
    every = merged(lines, site)
    for s, m.next in zip(every, [*every[1:], ""]):
        if LABEL.match(s) and m.item:
            m.flush()
        for _, test, act in BY_STATE[m.state][FIGURE.fullmatch(s) is not None]:
            if test(m, s):
                act(m, s)
                break
    m.flush()
    return m.out


#: An end of line within a line's own content, and the sign that tells it, as they stand in joined lines.
ESCAPE = "\x1a"
# Whole records of the plain form: a row number, code and description, a unit, a quantity and two prices, each on its line. Read at once, they give what the rules give line by line.
RECORD = re.compile(r"^([0-9]{1,3})\n([A-Z]{2,5}[0-9]{3,7}) - (\S[^\n]+)\n([A-Za-z]{1,6}\.?)\n([0-9]{1,10}\.[0-9]{2,6})\n([0-9]{1,10}\.[0-9]{2,6})\n([0-9]{1,10}\.[0-9]{2,6})(?:\n|\Z)", re.M)
#: Digits as zeros: but for a customer's marks no rule tells one digit from another in a line that begins with a letter.
ZEROS = str.maketrans("123456789", "000000000")
#: What begins or goes on with an item; a line that matches none of these does nothing between records.
ACTIVE = (LINKED, LINK, PREFIXED, SUB_ROW, NUMBERED, NUMBERED_ALONE, GLUED, DESCRIBED, ALONE, PIPED, TORN)
INNER = re.compile(r">>>\s*component|^\s*L:|L\s*:\s*[A-Z0-9]+\s*-|(?:material|manopera|utilaj|transport):\s*$|cub", I)


@lru_cache(maxsize=1 << 16)
def _plain_text(code: str, text: str) -> str | None:
    """The description of a record's second line (its code with zeros for digits); None where its words need the rules."""
    told = re.sub(r"\s+", " ", text).strip()
    if len(told) < 3 or text != text.strip() or skipped(f"{code} - {text}", ()) or INNER.search(told) or SECTION_FOOTER.search(told):
        return None
    return told


@lru_cache(maxsize=1 << 12)
def _plain_unit(token: str) -> str | None:
    u = unit(token)
    return None if not u or u == "km" or skipped(token, ()) else u


@lru_cache(maxsize=1 << 16)
def _quiet(line: str) -> bool:
    """Whether a line does nothing where no item is open or one that has its prices, and joins with no other line."""
    if not line:
        return True
    if line != line.strip() or line[0].isdigit() or line.startswith(">>>") or FIGURE.fullmatch(line) or LABEL.match(line) or TORN.match(line):
        return False
    return skipped(line, ()) or not any(p.match(line) for p in ACTIVE)


@lru_cache(maxsize=8)
def _marks(site: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, site)), I)


def plain_records(text: str, site: tuple[str, ...] = SITE) -> tuple[list[tuple], int, int]:
    """The records of the plain form that a section's text begins with, where the rest begins, and the last row number.

    Between them only lines stand that do nothing. A record is code, description, unit, quantity and two prices; -1 says
    that nothing is left. A text with one of the `site` marks is left to the rules.
    """
    out, at, last = [], 0, 0
    if ESCAPE not in text and not (site and _marks(site).search(text)):
        for g in RECORD.finditer(text):
            if g.start() != at and not all(map(_quiet, text[at : g.start() - 1].split("\n"))):
                return out, at, last
            n, code, told, token, quantity, price, value = g.groups()
            n, um, quantity, told = int(n), _plain_unit(token), float(quantity), _plain_text(code.translate(ZEROS), told)
            if told is None or um is None or not quantity or n < 1 or (out and n < last and n > 5) or "M2" in code:
                return out, g.start(), last
            out.append((code, told, um, quantity, float(price), float(value)))
            at, last = g.end(), n
        if all(map(_quiet, text[at:].split("\n"))):
            return out, -1, last
    return out, at, last


def parse_text(text: str, site: tuple[str, ...] = SITE) -> tuple[list[tuple], list[dict] | None]:
    """The items of one section's text, lines apart by ends of line: first the records of the plain form, then what the rules find in the rest, None where nothing is left for them."""
    found, at, last = plain_records(text, site)
    if at < 0:
        return found, None
    m = Machine(site)
    if found:  # the last record is still open: what follows may belong to it
        code, told, um, quantity, *prices = found.pop()
        m.item, m.last_number, m.parent = Item(code, [told], um, quantity, prices), last, found[-1][0] if found else ""
    return found, parse_lines(unescaped(text[at:]), site, m)


def joined(lines: Column) -> Column:
    """Lines as one text, null if there are none; ends of line in a line's content are escaped. unescaped() gives them back."""
    odd = F.exists(lines, lambda x: x.contains("\n") | x.contains(ESCAPE))
    told = F.transform(lines, lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit("\n"), F.lit(ESCAPE + "n")))
    return F.when(F.size(lines) > 0, F.when(F.coalesce(odd, F.lit(False)), F.array_join(told, "\n")).otherwise(F.array_join(lines, "\n", "")))


def unescaped(text: str) -> list[str]:
    lines = text.split("\n")
    return [x.replace(ESCAPE + "n", "\n").replace(ESCAPE + "a", ESCAPE) for x in lines] if ESCAPE in text else lines


def register(spark) -> None:
    """The table function parse_lines(array of lines) for SQL: one row an item, in order."""
    from pyspark.sql.functions import udtf

    class ParseLines:
        def eval(self, lines):
            for i, r in enumerate(parse_lines([x or "" for x in lines or []])):
                yield i, r["cod"], r["denumire"], r["um"], float(r["cantitate"]), r["is_component"], r["parent_code"]

    ship(spark)
    spark.udtf.register("parse_lines", udtf(ParseLines, returnType="seq int, cod string, denumire string, um string, cantitate double, is_component boolean, parent_code string"))


#: Columns of rows that Items gives beside COLUMNS: the section's first page, and lines that may begin components' blocks.
NEAR = "array<struct<line_no:int,s:array<string>,code:string,name:string,kind:int,n:int>>"
MORE = f"first int, page_number int, near {NEAR}, kind int, n int"
FIELDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_NEAR = pa.list_(pa.struct([("line_no", pa.int32()), ("s", pa.list_(pa.string())), ("code", pa.string()), ("name", pa.string()), ("kind", pa.int32()), ("n", pa.int32())]))
SCHEMA = pa.schema([(c.split(" ", 1)[0], FIELDS.get(c.split(" ", 1)[1], _NEAR)) for c in f"{COLUMNS}, {MORE}".split(", ")])


class Items:
    """Items of sections as Arrow batches: those of the plain form column by column, others as rows."""

    def __init__(self, site: tuple[str, ...]):
        self.site, self.heads, self.plain, self.rows = site, [], [], []

    def add(self, head: dict, text: str) -> bool:
        """Reads a section's text; whether the rules read any of it."""
        found, more = parse_text(text, self.site)
        if found:
            self.heads.append((head, len(found)))
            self.plain += found
        if more:
            self.rows += [head | r | {"seq": len(found) + i} for i, r in enumerate(more)]
        return more is not None

    def full(self) -> bool:
        return len(self.plain) + len(self.rows) >= 10_000

    def batches(self):
        if self.plain:
            n, heads = len(self.plain), self.heads
            cod, den, um, quantity, price, value = zip(*self.plain)
            told = {"seq": [i for _, k in heads for i in range(k)], "cod": cod, "denumire": den, "um": um, "cantitate": quantity, "pret_material": price, "val_material": value}
            for c in ("doc_id", "deviz", "deviz_denumire", "first", "kind", "n"):
                told[c] = [x for h, k in heads for x in [h.get(c)] * k]
            fixed = {"is_component": False, "subcomponents": []} | {p: 0.0 for p in PRICES}
            yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) if f.name in told else pa.repeat(pa.scalar(fixed[f.name], f.type), n) if f.name in fixed else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=SCHEMA)
        self.heads, self.plain, self.rows = [], [], []


RESOURCE = re.compile(r"[0-9]{1,3}\s")


def near_blocks(lines: list[str]) -> list[tuple[int, list[str]]]:
    """The lines that may begin a component's block, each by its place, with the four lines behind it: markers, and what stands before a unit of time."""
    out = []
    for i, s in enumerate(lines):
        t, after = s.strip(" "), lines[i + 1] if i + 1 < len(lines) else ""
        if t.startswith(">>>") or (t[:1].isdigit() and RESOURCE.match(t) and after.strip(" ").rstrip(".").upper() in TIMES):
            out.append((i, [*lines[i : i + 5], "", "", "", ""][:5]))
    return out


def _values(c: pa.Array) -> list:
    if c.null_count == len(c):
        return [None] * len(c)
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


def parse_rows(rows: DataFrame, site: tuple[str, ...], blocks: bool) -> DataFrame:
    """COLUMNS and MORE of rows (doc_id, deviz, deviz_denumire, page_number, text) that come sorted, those of one section in one partition.

    A section's name is its first one that isn't null. With `blocks` a page whose lines may begin components' blocks is a row
    of its own, with them in `near`.
    """

    def run(batches):
        items = Items(site)

        def read(key, held):
            head = {"doc_id": key[0], "deviz": key[1], "deviz_denumire": next((d for d, _, _ in held if d is not None), None), "first": next((p for _, p, _ in held if p is not None), None)}
            ruled = items.add(head, "\n".join([t for _, _, t in held]))
            if ruled and blocks:
                for _, page, t in held:
                    near = near_blocks(unescaped(t))
                    if near:
                        items.rows.append(head | {"page_number": page, "near": [{"line_no": i, "s": s} for i, s in near]})

        last, held = None, []
        for b in batches:
            for doc, deviz, name, page, text in zip(*map(_values, b.columns)):
                if last != (doc, deviz):
                    if held:
                        read(last, held)
                        if items.full():
                            yield from items.batches()
                    last, held = (doc, deviz), []
                held.append((name, page, text))
        if held:
            read(last, held)
        yield from items.batches()

    return rows.select("doc_id", "deviz", "deviz_denumire", "page_number", "text").mapInArrow(run, f"{COLUMNS}, {MORE}")


def parse(lines: DataFrame, site: tuple[str, ...] = SITE) -> DataFrame:
    """Items of lines (doc_id, deviz, deviz_denumire, page_number, line_no, and content or, for rows of several lines in order, `lines`); seq counts within a document's section.

    Partitions come sorted, and a task holds the lines of one section. Lines that hold one of the `site` marks belong to no item.
    """
    ship(lines.sparkSession)
    key = ["doc_id", "deviz"]
    told = F.col("lines") if "lines" in lines.columns else F.array("content")
    rows = lines.select(F.col("doc_id").cast("string").alias("doc_id"), "deviz", "deviz_denumire", "page_number", "line_no", joined(told).alias("text")).filter("text is not null")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "page_number", "line_no")
    return parse_rows(rows.withColumn("page_number", F.lit(None).cast("int")), site, False).select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])
