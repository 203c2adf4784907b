"""Audits of discrepancies against the documents they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import audit_code, text
from ..session import small
from .pages import with_context

#: Signs of a code by which lines are looked up before they are searched.
GRAM = 4
#: An item code that may be a parent, and the codes among which variants are looked for (fixed values).
PARENT = r"([A-Z]{2,5}\d{2,4}[A-Z]?\d{0,2})"
SIMPLE = r"\b([A-Z]\d+[A-Z0-9]*)\b"


def occurrences(codes: DataFrame, lines: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number", "line_no")) -> DataFrame:
    """code and `by` of the lines (content) in which a code stands, as any part of them, case aside.

    Lines meet codes over the code's first signs, so no line is compared with all codes. Empty codes stand nowhere.
    """
    c = codes.select(F.upper(text("code")).alias("code")).filter("code <> ''").distinct().withColumn("__k", F.substring("code", 1, GRAM))
    keys = c.select("__k").distinct()
    parts = f"flatten(transform(sequence(1, {GRAM}), n -> CASE WHEN length(__u) >= n THEN transform(sequence(1, CASE WHEN n < {GRAM} THEN length(__u) ELSE length(__u) - {GRAM - 1} END), i -> substring(__u, i, n)) ELSE array() END))"
    short = f"CASE WHEN length(__u) >= {GRAM} THEN transform(sequence(1, length(__u) - {GRAM - 1}), i -> substring(__u, i, {GRAM})) ELSE array() END"
    u = lines.select(*by, F.upper("content").alias("__u"))
    some = keys.filter(F.length("__k") < GRAM).limit(1).count() > 0
    met = u.withColumn("__k", F.explode(F.array_distinct(F.expr(parts if some else short)))).join(small(keys), "__k", "left_semi").join(c, "__k")
    return met.filter(F.col("__u").contains(F.col("code"))).select("code", *by).distinct()


def variants(c: str = "code") -> Column:
    """A code with and without the dollar sign."""
    u = F.upper(text(c))
    return F.array(u, F.when(u.startswith("$"), F.expr(f"substring(upper(trim({c})), 2)")).otherwise(F.concat(F.lit("$"), u)))


def found_codes(codes: DataFrame, lines: DataFrame) -> DataFrame:
    """The codes that stand in a line, with or without the dollar sign."""
    v = codes.select(F.upper(text("code")).alias("__c")).distinct().withColumn("code", F.explode(variants("__c")))
    return v.join(occurrences(v, lines).select("code").distinct(), "code", "left_semi").select(F.col("__c").alias("code")).distinct()


def code_context(codes: DataFrame, lines: DataFrame, reach: int = 8, limit: int | None = None) -> DataFrame:
    """code, doc_id, page_number, line_no and the lines around each place where a code stands; of `limit` codes at most, in their order."""
    c = codes.select(audit_code("code").alias("code")).distinct()
    c = c.orderBy("code").limit(limit) if limit else c
    at = ["doc_id", "page_number", "line_no"]
    return occurrences(c, lines).join(with_context(lines, reach, reach).select(*at, "context"), at).select("code", *at, "context")


def table_context(codes: DataFrame, cells: DataFrame, reach: int = 3) -> DataFrame:
    """code, doc_id, table_idx, row_index and the rows around each table row in which a code stands, cells joined by ` | `."""
    key = ["doc_id", "table_idx"]
    rows = cells.groupBy(*key, "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "content"))), lambda x: x["content"]), " | ").alias("content"))
    c = codes.select(audit_code("code").alias("code")).distinct()
    at = [*key, "row_index"]
    return occurrences(c, rows, tuple(at)).join(with_context(rows, reach, reach, tuple(key), "row_index").select(*at, "context"), at).select("code", *at, "context")


def parents(codes: DataFrame, lines: DataFrame, reach: int = 5) -> DataFrame:
    """code and parent: the first item code on each of the five lines before one in which a code stands, other than the code itself."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(-reach, -1)
    own = F.regexp_extract(F.upper("content"), PARENT, 1)
    near = lines.withColumn("__p", F.collect_list(F.when(own != "", own)).over(w)).select("doc_id", "page_number", "line_no", "__p")
    hit = occurrences(codes, lines).join(near, ["doc_id", "page_number", "line_no"])
    return hit.select("code", F.explode("__p").alias("parent")).filter("parent <> code").distinct()


def extra_causes(extra: DataFrame, ref_lines: DataFrame) -> DataFrame:
    """code and cause of surplus items: exact (the code stands in the reference, with or without dollar), parent (an item code stands in the five lines before it), genuine."""
    e = extra.select(F.upper(text("oferta_cod")).alias("code")).filter("code <> ''").distinct()
    exact = found_codes(e, ref_lines).withColumn("x", F.lit(1))
    parent = parents(e, ref_lines).select("code").distinct().withColumn("p", F.lit(1))
    return e.join(exact, "code", "left").join(parent, "code", "left").select("code", F.when(F.col("x") == 1, "exact").when(F.col("p") == 1, "parent").otherwise("genuine").alias("cause"))


def missing_causes(missing: DataFrame, offer_lines: DataFrame) -> DataFrame:
    """code and cause of missing items: exact (the code stands in the offer, with or without dollar), variant (a letter-and-digits code there begins with its first three signs, or equals it once O and I are read as digits), genuine."""
    m = missing.select(F.upper(text("ref_cod")).alias("code")).filter("code <> ''").distinct()
    exact = found_codes(m, offer_lines).withColumn("x", F.lit(1))
    t = offer_lines.select(F.explode(F.regexp_extract_all(F.upper("content"), F.lit(SIMPLE), F.lit(1))).alias("t")).distinct()
    c = m.withColumn("bare", audit_code("code"))
    start = c.withColumn("k", F.substring("bare", 1, 3)).join(t.withColumn("k", F.substring("t", 1, 3)), "k").filter("t <> bare").select("code")
    read = c.join(t, F.translate("t", "OI", "01") == F.col("bare")).filter("t <> bare").select("code")
    variant = start.union(read).distinct().withColumn("v", F.lit(1))
    return m.join(exact, "code", "left").join(variant, "code", "left").select("code", F.when(F.col("x") == 1, "exact").when(F.col("v") == 1, "variant").otherwise("genuine").alias("cause"))
