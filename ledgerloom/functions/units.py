"""Units of measure and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import text

# The units that items may have, and tokens that look like units but are not.
KNOWN_UNITS = (
    "BUC", "BUCATA", "BUCAT", "MC", "ML", "MP", "MPC", "KG", "T", "TO", "TON", "TONA", "TONE", "G", "MG", "L", "M", "H", "DM", "KM",
    "KW", "KWH", "KVA", "W", "ORA", "ORE", "OREI", "ZI", "ZILE", "SCHIMB", "LUNA", "LUNI", "SAPT",
    "SET", "PERECHE", "ROLA", "PAG", "ART", "ROT", "LEI", "MII",
)
NOT_UNITS = ("ASIM", "TSCH", "SCH", "UM", "NR", "CRT", "TOTAL", "PU", "VAL")
# Synonyms on the line path; kg as tona and l as ml lose the scale, as results require.
SYNONYMS = {
    "mc": ("m cub", "m3", "mc", "m³"),
    "mp": ("mp", "m²", "m2"),
    "buc": ("buc", "bucata", "buc.", "bucati"),
    "ml": ("ml", "litru", "l", "ltr"),
    "tona": ("tona", "ton", "t", "kg"),
    "m": ("m", "meter", "mt"),
}


def compare_unit(c) -> Column:
    """A unit for comparison: upper case without blanks and dots; ML is M."""
    u = F.regexp_replace(F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"[\s.]+", "")
    return F.when(u == "ML", "M").otherwise(u)


def line_unit(c) -> Column:
    """A unit by its synonym; others lower-cased."""
    t = F.lower(text(c))
    out = t
    for name, words in SYNONYMS.items():
        out = F.when(t.isin(*words), name).otherwise(out)
    return out


def _bare(c) -> Column:
    return F.upper(F.regexp_replace(text(c), r"[.\s]", ""))


def is_unit(c) -> Column:
    """Whether a token is a unit: a known one, square or cubic metres, or a known one under OCR noise."""
    low, t = F.lower(text(c)), _bare(c)
    quiet = F.regexp_replace(t, r"[?!|~^]", "")
    return (
        F.when(low.isin("m cub", "m3", "m cu b") | low.contains("m²") | low.contains("m2"), True)
        .when((t == "") | t.isin(*NOT_UNITS), False)
        .when(low.rlike(r"\d") & ~t.isin("M2", "M3"), False)
        .when(t.isin(*KNOWN_UNITS), True)
        .otherwise(t.rlike(r"[?!|~^]") & quiet.isin(*KNOWN_UNITS))
    )


def unit_value(c) -> Column:
    """The unit that a token stands for."""
    low, t = F.lower(text(c)), _bare(c)
    quiet = F.regexp_replace(t, r"[?!|~^]", "")
    return (
        F.when(t == "", "")
        .when(low.isin("m cub", "m3", "m cu b"), "mc")
        .when(low.isin("mp", "m²", "m2"), "mp")
        .when(low.isin("zeci m", "zeci"), "m")
        .when(t.isin("BUC", "BUCATA", "BUCAT"), "buc")
        .when(t == "TONE", "tona")
        .when(t.isin("ORE", "OREI"), "ora")
        .when(t.isin(*KNOWN_UNITS), t)
        .when(t.rlike(r"[?!|~^]") & quiet.isin(*KNOWN_UNITS), quiet)
        .otherwise(t)
    )


def parse_number(c) -> Column:
    """A number with either decimal sign; of two signs the earlier groups thousands; 0 where it is none."""
    t = F.regexp_replace(text(c), " ", "")
    dot, comma = F.instr(t, "."), F.instr(t, ",")
    plain = (
        F.when((dot > 0) & (comma > 0) & (dot < comma), F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when((dot > 0) & (comma > 0), F.regexp_replace(t, ",", ""))
        .otherwise(F.translate(t, ",", "."))
    )
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double")).otherwise(F.lit(0.0))


def table_quantity(c) -> Column:
    """The leading number of a table cell such as 99 M; with both signs the comma is decimal and the first dot goes."""
    n = F.regexp_extract(text(c), r"^([\d.,]+)", 1)
    both = n.contains(".") & n.contains(",")
    dotted = F.translate(n, ",", ".")
    one = F.regexp_replace(dotted, r"^(\d*)\.", "$1")
    plain = F.when(both, one).otherwise(dotted)
    return F.when(plain.rlike(r"^\d*\.?\d+$|^\d+\.$"), plain.try_cast("double")).otherwise(F.lit(0.0))


def table_unit(quantity, unit) -> Column:
    """The unit cell in upper case without dots, behind the letters at the quantity cell's end; a column number from 0 to 5 alone is none."""
    own, u = F.regexp_extract(text(quantity), r"([A-Za-z]+)$", 1), F.upper(text(unit))
    both = F.translate(F.when(own != "", F.trim(F.concat(own, F.lit(" "), u))).otherwise(u), ".", "")
    return F.when(both.isin("0", "1", "2", "3", "4", "5"), "").otherwise(both)


def is_price_line(c) -> Column:
    return text(c).rlike(r"^\s*\d+[.,]\d{2}\s*$|RON|EUR|USD|lei|\$|€")


def is_model_reference(c) -> Column:
    return text(c).rlike(r"(?i)^[A-Z]{2,3}\d{2,4}$")
