"""Item codes, section codes and their keys, as column expressions. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """A column as text, null as empty, without blanks around it."""
    return F.trim(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")))


def clean_code(c) -> Column:
    """Upper case, only letters, digits and the dollar sign."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9$]", "")


def normalize_code(c) -> Column:
    """A code's form for the second matching layer: look-alikes L, I, O become digits, and numeric codes start with a dollar sign.

    Eight or more digits after the dollar sign are cut to seven; letters with four or five digits keep the digits only;
    of others the leading normative code is kept.
    """
    u = F.translate(F.upper(text(c)), "LIO", "110")
    digits = F.regexp_replace(u, "[^0-9]", "")
    normative = F.regexp_extract(u, r"^([A-Z]{2,5}\d{2,4}[A-Z]?\d{0,2})", 1)
    return (
        F.when(u.startswith("$"), F.when(digits == "", u).otherwise(F.concat(F.lit("$"), F.when(F.length(digits) >= 8, F.substring(digits, 1, 7)).otherwise(digits))))
        .when(u.rlike(r"^\d+$"), F.concat(F.lit("$"), u))
        .when(u.rlike(r"^[A-Z]{2,5}\d{4,5}$"), F.concat(F.lit("$"), F.regexp_extract(u, r"(\d{4,5})$", 1)))
        .when(normative != "", normative)
        .otherwise(F.regexp_replace(u, "[^A-Z0-9]", ""))
    )


def normalize_section(c) -> Column:
    """A section code with the letter U read as zero."""
    return F.translate(text(c), "U", "0")


def section_name_key(c) -> Column:
    """A section's name as a key: no leading numbers, OB 2 as OB2, single spaces."""
    u = F.regexp_replace(F.upper(text(c)), r"^(\d+\s+)+", "")
    u = F.regexp_replace(u, r"\b(OB|NR|CAP|ART)[\s.]*(\d+)", "$1$2")
    return F.trim(F.regexp_replace(u, r"\s+", " "))


def section_key(code, name) -> Column:
    """The section's code, or its name's key where there is no code."""
    return F.when(text(code) != "", normalize_section(code)).otherwise(section_name_key(name))


def item_key(section, name, code) -> Column:
    return F.struct(section_key(section, name).alias("section"), clean_code(code).alias("code"))


def strip_section_prefix(c) -> Column:
    """A section's name without physical-stage label, the word oferta, a chapter number and a code; unchanged if nothing is left."""
    t = text(c)
    cut = F.trim(F.regexp_replace(t, r"(?i)^(?:STADIUL?\s+FIZIC\s*:?\s*)?(?:oferta\s+)?(?:\d{1,3}\s+)?(?:[A-Z0-9]{4,8}\s+)?", ""))
    return F.when(cut == "", t).otherwise(cut)


def section_prefix(c) -> Column:
    """What stands before a hyphen, else the first word, lower-cased."""
    t = F.lower(text(c))
    return F.trim(F.when(t.contains("-"), F.split_part(t, F.lit("-"), F.lit(1))).otherwise(F.split_part(t, F.lit(" "), F.lit(1))))


def is_numeric_code(c) -> Column:
    return text(c).rlike(r"^\$?\d+$")


def clean_table_code(c) -> Column:
    """A table's code without a variant number and the marks at its end."""
    return F.regexp_replace(F.regexp_replace(text(c), r"-\d+[#@!]*$", ""), r"[#@!]+$", "")


def audit_code(c) -> Column:
    return F.upper(F.regexp_replace(text(c), r"[#\-\s]+$", ""))


def generated_section_code(prefix: str, name, i) -> Column:
    """PREFIX_NAME_NN from the first eight letters and digits of a name and a number."""
    slug = F.substring(F.regexp_replace(F.upper(text(name)), "[^A-Z0-9]", ""), 1, 8)
    return F.format_string(prefix + "_%s_%02d", slug, i.cast("int"))


def strip_plus(c) -> Column:
    return F.regexp_replace(text(c), r"\++$", "")
