"""Text and line expressions: descriptions, cells, component codes, replies, report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import clean_table_code, text

#: Item codes in running text (fixed value).
ITEM_CODE = r"\b(?:[A-Z]{2,5}\d{1,4}[A-Z]?\d{0,2}|[A-Z]\d[A-Z]{1,3}\d{2,4}[A-Z]?\d{0,2})\b"
#: Component references `L:PREFIX -NUMBER:CODE` (fixed value).
PREFIXED = r"(?i)L\s*:\s*([A-Z0-9]+)\s*-\s*([A-Z0-9]*)\s*:\s*([0-9A-Z]+)"
#: Component formats in the order in which they are tried (fixed values): pattern, group of the code, confidence.
FORMATS = {
    "PREFIXED": (r"L\s*:\s*([A-Z0-9]+)\s*-\s*([A-Z0-9]*)\s*:\s*([0-9A-Z]+)", 3, 0.95),
    "SIMPLE": (r"(\d+\.\d+)\s+([A-Z0-9]+)\s*-", 2, 0.95),
    "MARKER": (r">>>\s*componenta\s+(\d+)\s+(\d+)\s+([A-Z0-9]+)", 3, 0.95),
}


def plain_description(c) -> Column:
    """Lower case, straight quotes, no dot after a letter before a blank, single spaces."""
    t = F.translate(F.lower(text(c)), "\"`´’‘“”", "'''''''")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([a-zăâîșț])\.(?=\s)", "$1"), r"\s+", " "))


#: Table cells `CODE - DESCRIPTION` (fixed values): a code of one of three kinds, or any run of the signs that codes have.
CELL = r"(?i)^(\$?\d{4,8}|[A-Z]{2,5}\d{1,4}[A-Z]?(?:-\d+)?(?:#)?|[A-Z]\d[A-Z]{1,3}\d{2,4}[A-Z]?(?:-\d+)?(?:#)?)\s*[-–]\s*(.+)"
LOOSE_CELL = r"(?i)^([A-Z0-9#@\-]{2,10})\s*[-–]\s*(.+)"


def dollared(code) -> Column:
    """A code, with a dollar sign before one of digits only."""
    return F.when(code.rlike(r"^\d+$"), F.concat(F.lit("$"), code)).otherwise(code)


def item_cell(c) -> Column:
    """code (upper case) and description of a table cell `CODE - DESCRIPTION`, empty where it is none; a numeric code gets a dollar sign."""
    t = text(c)
    loose = clean_table_code(F.upper(F.regexp_extract(t, LOOSE_CELL, 1)))
    strict = F.upper(F.regexp_extract(t, CELL, 1))
    code = F.when(strict != "", dollared(strict)).when(F.length(loose) >= 2, loose).otherwise("")
    den = F.when(strict != "", F.regexp_extract(t, CELL, 2)).when(F.length(loose) >= 2, F.regexp_extract(t, LOOSE_CELL, 2)).otherwise("")
    return F.struct(code.alias("code"), F.trim(den).alias("description"))


def component_codes(c) -> Column:
    """The codes of all component references, upper-cased."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(PREFIXED), F.lit(3)), F.upper)


def text_codes(c, exclude: tuple[str, ...] = ()) -> Column:
    """Distinct item codes of a text, some prefixes of other documents excluded."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit(r"\b([A-Z]{2,5}\d{2,4}[A-Z0-9]{0,4})\b"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, exclude))) if exclude else found


def has_item_codes(c) -> Column:
    return text(c).rlike(ITEM_CODE) | text(c).rlike(r"\$[A-Z0-9]{4,8}")


def component_format(c) -> Column:
    """The first component format that a text shows, UNKNOWN otherwise."""
    out = F.lit("UNKNOWN")
    for name, (pattern, _, _) in reversed(FORMATS.items()):
        out = F.when(text(c).rlike(pattern), name).otherwise(out)
    return out


def format_confidence(fmt) -> Column:
    out = F.lit(0.0)
    for name, (_, _, confidence) in FORMATS.items():
        out = F.when(fmt == name, confidence).otherwise(out)
    return out


def format_codes(c, fmt: str) -> Column:
    """All component codes of a text in one format."""
    pattern, group, _ = FORMATS.get(fmt, (r"(\b\B)", 1, 0.0))
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def format_code(c, fmt: str) -> Column:
    """The first component code of a text in one format, null without one."""
    return F.get(format_codes(c, fmt), F.lit(0))


def physical_stage(c) -> Column:
    """What follows the physical-stage label, up to a number or the line's end; empty where a number follows at once."""
    return F.trim(F.regexp_extract(text(c), r"(?im)STADIUL\s+FIZIC:\s*([^\n0-9]+?)(?:\s+[0-9]|\s*$)", 1))


#: A section behind its physical-stage label (fixed values): a chapter and a sub-code, a sub-code, a code of 5 to 8 signs before a digit.
STAGE_FORMS = (r"^\d{1,3}\s+([0-9]\.[0-9])\s+(.*)", r"^([0-9]\.[0-9])\s+(.*)", r"^(?i:oferta\s+)?(?:\d{1,3}\s+)?((?=.*\d)(?i:[A-Z0-9]{5,8}))\s*(.*)")


def stage_section(c) -> Column:
    """code and name of a section from its physical stage (behind the label, if the text has it): the first of STAGE_FORMS, else the whole as name.

    A name that a catalogue knows is sections.lookup_text()'s to find.
    """
    t = F.trim(F.regexp_replace(text(c), r"(?is)^.*?STADIUL?\s+FIZIC\s*:\s*", ""))
    out = F.struct(F.lit("").alias("code"), t.alias("name"))
    for p in reversed(STAGE_FORMS):
        out = F.when(t.rlike(p), F.struct(F.upper(F.regexp_extract(t, p, 1)).alias("code"), F.trim(F.regexp_extract(t, p, 2)).alias("name"))).otherwise(out)
    return out


#: A section's name in the heading of its form (fixed values), up to the category or the list.
FORM_NAMES = (r"(?i)Deviz\s+oferta\s+\d{5,8}\s+(.+?)(?=\s+(?:Categ|Lista))", r"(?i)Obiectul\s*:\s*\d+\s+(.+?)(?=\s+(?:Categ|Lista))")


def form_section_name(c) -> Column:
    """A section's name from the heading of its form: behind the bid's label, else behind the object's; empty without either."""
    first, second = (F.trim(F.regexp_extract(text(c), p, 1)) for p in FORM_NAMES)
    return F.when(first != "", first).otherwise(second)


def reply_json(c) -> Column:
    """The JSON object in a free-text reply: the whole of it, a fenced block, or the outermost braces; {} otherwise."""
    t = text(c)
    tries = [t, F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)]
    valid = [F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), F.trim(x)) for x in tries]
    return F.coalesce(*valid, F.lit("{}"))


def shortened(c, most: int) -> Column:
    t = text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def programme_name(c) -> Column:
    """The section name of a surplus item: up to the name of the programme that printed it, or 100 characters."""
    t = text(c)
    return F.when(t.contains("e Devize"), F.trim(F.substring_index(t, "e Devize", 1))).otherwise(F.substring(t, 1, 100))


# The names of fields in a report's texts.
FIELD_LABELS = {
    "cantitate": "Cantitate", "pret_material": "Preț material", "pret_manopera": "Preț manoperă", "pret_utilaj": "Preț utilaj", "pret_transport": "Preț transport",
    "val_material": "Valoare material", "val_manopera": "Valoare manoperă", "val_utilaj": "Valoare utilaj", "val_transport": "Valoare transport",
}


def observation(tip="tip", camp="camp", ref="ref", offer="oferta", ref_um="ref_um", offer_um="oferta_um", ref_code="ref_cod", offer_code="oferta_cod", reason=None, declared=None, calculated=None) -> Column:
    """The report's text for a discrepancy, from its columns; missing values show as nothing. The sentences are fixed values."""
    c = lambda x: F.lit("") if x is None else F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    t, f, why = c(tip), c(camp), c(reason)
    label = f
    for name, shown in FIELD_LABELS.items():
        label = F.when(f == name, shown).otherwise(label)
    unit = F.when(f == "cantitate", c(ref_um)).otherwise("lei")
    return (
        F.when(t == "ARTICOL_LIPSA", "Articol lipsă din ofertă")
        .when(t == "ARTICOL_EXTRA", "Articol suplimentar în ofertă (nu există în referință)")
        .when(t == "UM_DIFERIT", F.concat(F.lit("Unitate de măsură diferită: referință "), c(ref_um), F.lit(", ofertat "), c(offer_um)))
        .when(t == "DIFERENTA_CAMP", F.trim(F.concat(label, F.lit(" diferită: referință "), c(ref), F.lit(" "), unit, F.lit(", ofertat "), c(offer), F.lit(" "), unit)))
        .when(t == "EROARE_ARITMETICA", F.concat(F.lit("Eroare aritmetică: "), f, F.lit(" declarat "), c(declared), F.lit(" lei ≠ calculat "), c(calculated), F.lit(" lei")))
        .when(t == "COD_SIMILAR", F.concat(F.lit("Cod similar — posibilă eroare OCR sau variație: referință '"), c(ref_code), F.lit("', ofertat '"), c(offer_code), F.lit("'. "), why, F.lit(". Necesită verificare manuală.")))
        .when(t == "ARTICOL_ORPHAN", F.concat(F.lit("ORPHAN: Cod '"), c(ref_code), F.lit("' identic, dar categorii DIFERITE. "), why, F.lit(". VERIFICARE MANUALA NECESARA!")))
        .otherwise(t)
    )


# The names of fields in a spreadsheet's texts.
SHEET_LABELS = {
    "cantitate": "CANTITATE DIFERITĂ", "pret_material": "PREȚ MATERIAL DIFERIT", "pret_manopera": "PREȚ MANOPERĂ DIFERIT", "pret_utilaj": "PREȚ UTILAJ DIFERIT", "pret_transport": "PREȚ TRANSPORT DIFERIT",
    "val_material": "VALOARE MATERIAL DIFERITĂ", "val_manopera": "VALOARE MANOPERĂ DIFERITĂ", "val_utilaj": "VALOARE UTILAJ DIFERITĂ", "val_transport": "VALOARE TRANSPORT DIFERITĂ",
}


def sheet_observation(columns: list[str]) -> Column:
    """A spreadsheet's text for a discrepancy, from its columns; those that are missing or null show as nothing. The sentences are fixed values."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in columns else F.lit("")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    label = say("DIFERENȚĂ ", F.upper(c("camp")))
    for name, shown in SHEET_LABELS.items():
        label = F.when(c("camp") == name, shown).otherwise(label)
    return (
        F.when(c("tip") == "ARTICOL_LIPSA", "LIPSĂ ARTICOL")
        .when(c("tip") == "ARTICOL_EXTRA", "ARTICOL SUPLIMENTAR ÎN OFERTĂ")
        .when(c("tip") == "UM_DIFERIT", say("UNITATE DE MĂSURĂ DIFERITĂ\nRef: ", c("ref_um"), "  |  Ofertă: ", c("oferta_um")))
        .when(c("tip") == "DIFERENTA_CAMP", say(label, "\nRef: ", c("ref"), "  |  Ofertă: ", c("oferta")))
        .when(c("tip") == "EROARE_ARITMETICA", say("EROARE ARITMETICĂ: ", c("camp"), "\nDeclarat: ", c("declarat"), "  Calculat: ", c("calculat")))
        .when(c("tip") == "COD_SIMILAR", say("COD SIMILAR — posibilă eroare OCR sau variație\nRef: ", c("ref_cod"), "  |  Ofertat: ", c("oferta_cod"), "\n", c("motiv_similaritate")))
        .otherwise(c("tip"))
    )


def systemic_alert(part: float) -> str:
    """The spreadsheet's alert for the part of checked items that are suspect (a fixed value)."""
    return f"⚠️ ALERTĂ SISTEMICĂ: {int(part * 100)}% din itemii verificați sunt suspecți"


def hierarchy_label(code, is_component, parent) -> Column:
    """A code as a report shows it: a component's with a mark, and its parent where it has one."""
    of = F.when(text(parent) != "", F.concat(F.lit(" (parent: "), text(parent), F.lit(")"))).otherwise("")
    return F.when(F.coalesce(is_component, F.lit(False)), F.concat(F.lit("[COMPONENT] "), text(code), of)).otherwise(text(code))
