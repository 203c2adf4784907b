"""Counts and reports by type and section, coverage, patterns and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import text
from ..functions.texts import FORMATS, component_format, format_codes, format_confidence


def by_type(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "tip").agg(F.count("*").alias("n"))


def by_section(items: DataFrame) -> DataFrame:
    return items.filter(text("deviz") != "").groupBy("deviz").agg(F.count("*").alias("art_count"))


def section_report(rows: DataFrame, ref: DataFrame, offer: DataFrame) -> DataFrame:
    """deviz with its discrepancies, those missing and surplus, their difference, distinct reference codes concerned, and both totals.

    Sections come in numeric order, those that aren't numbers last: order by sort_key and deviz.
    """
    d = rows.withColumn("deviz", F.coalesce("ref_deviz", "oferta_deviz")).filter(text("deviz") != "").groupBy("deviz").agg(
        F.count("*").alias("neconf"), F.count_if(F.col("tip") == "ARTICOL_LIPSA").alias("lipsa"), F.count_if(F.col("tip") == "ARTICOL_EXTRA").alias("extra"),
        F.count_distinct("ref_cod").alias("ref_coduri"),
    )
    t = d.join(by_section(ref).withColumnRenamed("art_count", "total_ref"), "deviz", "left").join(by_section(offer).withColumnRenamed("art_count", "total_oferta"), "deviz", "left")
    return t.select("deviz", "neconf", "lipsa", "extra", (F.col("extra") - F.col("lipsa")).alias("delta"), "ref_coduri", F.coalesce("total_ref", "neconf").alias("total_ref"), F.coalesce("total_oferta", F.lit(0)).alias("total_oferta"), F.col("deviz").try_cast("int").alias("sort_key"))


def grouped_discrepancies(rows: DataFrame) -> DataFrame:
    """deviz and its discrepancies as an array in the order of type and code."""
    return rows.withColumn("deviz", F.coalesce("ref_deviz", "oferta_deviz")).groupBy("deviz").agg(F.count_distinct("ref_cod").alias("n_ref"), F.count_distinct("oferta_cod").alias("n_oferta"), F.sort_array(F.collect_list(F.struct("tip", "ref_cod", "oferta_cod", "camp"))).alias("rows"))


def rolled_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts over a rollup of the keys, with the level in gid."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def coverage(found: DataFrame, detected: DataFrame) -> DataFrame:
    """extracted and detected distinct codes, covered (those that are both), extracted over detected to three decimals (1 if none is detected, above 1 if more were extracted), and a warning below 0.7."""
    codes = lambda rows, name: rows.filter(text("code") != "").select(F.upper(text("code")).alias("code")).distinct().withColumn(name, F.lit(True))
    both = codes(detected, "d").join(codes(found, "e"), "code", "full_outer")
    one = both.agg(F.count("d").alias("detected"), F.count("e").alias("extracted"), F.count_if(F.col("d") & F.col("e")).alias("covered"))
    part = F.when(F.col("detected") > 0, F.col("extracted") / F.col("detected")).otherwise(F.lit(1.0))
    return one.withColumn("ratio", F.floor(part * 1000 + 0.5) / 1000).withColumn("warn", part < 0.7)


def suspicious_extras(extra: DataFrame, ref_text: DataFrame, ref_items: DataFrame) -> DataFrame:
    """extra with posibil_omis_din_extractie: the code stands in the reference's lines (content), as any part of them, yet no item was extracted for it."""
    from .audits import occurrences

    known = ref_items.select(F.upper(text("cod")).alias("code")).distinct()
    rows = ref_text.select(F.lit(0).alias("line"), "content")
    hit = occurrences(extra.select(F.col("oferta_cod").alias("code")), rows, ("line",)).join(known, "code", "left_anti").select(F.col("code").alias("__t"), F.lit(True).alias("__hit")).distinct()
    return extra.withColumn("__t", F.upper(text("oferta_cod"))).join(hit, "__t", "left").withColumn("posibil_omis_din_extractie", F.coalesce("__hit", F.lit(False))).drop("__t", "__hit")


def pattern_scores(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, name, confidence and at (the pattern's place in the library): lines that begin as one of a pattern's parents, and those that begin as one of its components, over lines that aren't blank; half more if both occur, 1 at most.

    Every line is read once, with all patterns as expressions on it. The library is a hand-made list and comes to the driver.
    """
    bare = F.regexp_replace("content", r"^\s+|\s+$", "")
    full = lines.select("doc_id", bare.alias("s")).filter("s <> ''")
    begins = lambda ways: reduce(lambda a, b: a | b, [F.rlike("s", F.lit(f"^(?:{p})")) for p in ways], F.lit(False))
    library = patterns.select("name", "parent_indicators", F.transform("component_indicators", lambda x: x["pattern"]).alias("component_indicators")).collect()
    sums = [F.struct(F.lit(p.name).alias("name"), F.lit(i).alias("at"), F.count_if(begins(p.parent_indicators or [])).alias("a"), F.count_if(begins(p.component_indicators or [])).alias("b")) for i, p in enumerate(library)]
    kind = "array<struct<name:string,at:int,a:bigint,b:bigint>>"
    n = full.groupBy("doc_id").agg(F.count("*").alias("total"), F.array(*sums).cast(kind).alias("p")).select("doc_id", "total", F.inline("p")).filter("a + b > 0")
    base = (F.col("a") + F.col("b")) / F.col("total")
    return n.select("doc_id", "name", F.least(F.lit(1.0), F.when((F.col("a") > 0) & (F.col("b") > 0), base * 1.5).otherwise(base)).alias("confidence"), "at")


def best_pattern(scores: DataFrame, docs: DataFrame, least: float = 0.70, generated: str = "AUTO_GEN_1") -> DataFrame:
    """doc_id, name and confidence of the best pattern of 0.7 or more, the first of the library among equal ones, else the generated one's at 0.5."""
    b = scores.groupBy("doc_id").agg(F.max_by("name", F.struct("confidence", -F.col("at"))).alias("name"), F.max("confidence").alias("c")).filter(F.col("c") >= least)
    return docs.select("doc_id").distinct().join(b, "doc_id", "left").select("doc_id", F.coalesce("name", F.lit(generated)).alias("name"), F.coalesce("c", F.lit(0.5)).alias("confidence"))


def generated_pattern(patterns: DataFrame) -> DataFrame:
    """The template for documents that no pattern of the library fits, as a row of it: named by the library's size, parents by a number and a capital."""
    n = patterns.agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("AUTO_GEN_"), F.col("n") + 1).alias("name"), F.array(F.lit(r"^\d+\s+[A-Z]")).alias("parent_indicators"), F.array().cast("array<struct<pattern:string,type:string>>").alias("component_indicators"), F.lit("inherit_from_parent").alias("quantity_rule"))


def component_summary(docs: DataFrame, text_col: str = "text", expected: str | None = None) -> DataFrame:
    """doc_id, format, confidence, n_codes (all that the format shows), warnings and valid (codes were found, and as many as expected).

    `expected` is a column with the number of codes that a document should have; null and 0 ask for nothing. Where codes are
    expected and none is found, the confidence is halved. The warnings are fixed values.
    """
    codes = F.array().cast("array<string>")
    for name in FORMATS:
        codes = F.when(F.col("format") == name, format_codes(text_col, name)).otherwise(codes)
    out = docs.withColumn("format", component_format(text_col)).withColumn("n_codes", F.size(F.filter(codes, lambda x: F.trim(x) != "")))
    want = F.coalesce(F.col(expected).cast("int") if expected else F.lit(0), F.lit(0))
    none = (F.col("n_codes") == 0) & (want > 0)
    warn = F.array_compact(F.array(F.when(none, F.format_string("Expected %d subcomponents but extracted 0", want)), F.when((want != 0) & (F.col("n_codes") != want), F.format_string("Extracted %d codes but expected ~%d", F.col("n_codes"), want))))
    c = format_confidence(F.col("format"))
    return out.select("doc_id", "format", F.when(none, c * 0.5).otherwise(c).alias("confidence"), "n_codes", warn.alias("warnings"), ((F.size(warn) == 0) & (F.col("n_codes") > 0)).alias("valid"))


def verify_expected(expected: DataFrame, items: DataFrame, similarity, scope: tuple[str, ...] = ()) -> DataFrame:
    """code, status (complete from 0.9, incomplete from 0.7, found, missing) and the best score of an expected description, among the items of its code and `scope`."""
    j = expected.join(items.select(*scope, F.upper(text("cod")).alias("code"), "denumire"), [*scope, "code"], "left").withColumn("s", F.when(F.col("denumire").isNotNull(), similarity("description", "denumire")))
    best = j.groupBy(*scope, "code", "description").agg(F.max("s").alias("score"))
    return best.withColumn("status", F.when(F.col("score").isNull(), "missing").when(F.col("score") >= 0.9, "complete").when(F.col("score") >= 0.7, "incomplete").otherwise("found"))
