"""Mixing sources to target weights, by hash-threshold histograms.

Every document has a fixed pseudo-random key of nine hexadecimal digits. For each source, words are summed by the key's
first three digits; the bucket in which the source's budget ends is found by a running sum, and only that bucket is
summed again by the next three digits, and once more by the last three. What lies below the threshold gets one copy
more than what lies above. Nothing is sorted and no document leaves its partition; histograms have at most 4096 rows a
source. A larger budget only raises the threshold, so mixes of different sizes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, small, staged, table, without

#: Hexadecimal digits of the key that each refinement resolves, and how often.
DIGITS, LEVELS = 3, 3
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(key: Column) -> Column:
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS * LEVELS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: the share of all words dealt to sources by weight, none above `most` times its size.

    Weights repeat over the sources in code-point order, null last. The rank comes from range partitions and their
    counts, and the level of the water filling from running sums over ranges of cap by weight, so no task holds all sources.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = staged(src.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = src.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = staged(src.join(F.broadcast(offset), "pid").select("source", "source_size", pick.alias("w"), (F.col("source_size") * float(most)).alias("cap")), "mix-weights")
    size, weight = src.agg(F.sum("source_size"), F.sum("w")).first()
    ratio = src.withColumn("ratio", F.col("cap") / F.col("w"))
    by = ["ratio", F.col("source").asc_nulls_last()]
    ratio = staged(ratio.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "mix-ratios")
    past = ratio.groupBy("pid").agg(F.sum("cap").alias("c"), F.sum("w").alias("f")).select("pid", *[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(x) for x in ("c", "f")])
    here = Window.partitionBy("pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    done = lambda x, name: F.coalesce(F.sum(x).over(here), F.lit(0.0)) + F.col(name)
    # below a source's ratio all before it are full and share the rest by weight; the level is where that first holds
    level = (F.lit(float(size or 0) * share) - done("cap", "c")) / (F.lit(float(weight or 0)) - done("w", "f"))
    first = ratio.join(F.broadcast(past), "pid").withColumn("level", level).filter("level <= ratio")
    level = first.agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source"))).first()[0]
    fill = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return src.select("source", "source_size", fill.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every document), cut and inclusive: keys below the cut get one copy more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = staged(targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    state = plan.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("used"))
    for level in range(LEVELS):
        st = small(state.withColumnRenamed("source", "s"))
        digits = F.substring("h", level * DIGITS + 1, DIGITS)
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, level * DIGITS) == F.col("prefix"))
        hist = sizes.filter("size > 0").join(st, inside).groupBy("source", "budget", "prefix", "used", digits.alias("d")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) + F.col("used")
        hist = hist.withColumn("upto", upto).filter("upto > budget and upto - n <= budget")
        state = staged(hist.select("source", "budget", F.concat("prefix", "d").alias("prefix"), (F.col("upto") - F.col("n")).alias("used"), "n"), "mix-level")
    edge = state.select(F.col("source").alias("s"), F.col("prefix").alias("cut"), (F.col("used") + F.col("n") - F.col("budget") < F.col("budget") - F.col("used")).alias("inclusive"))
    return staged(plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "inclusive"), "mix-cuts")


def _apply(rows: DataFrame, cuts: DataFrame, source_col: str) -> DataFrame:
    """rows (with `size` and the key `__mix_h`) with source_size, target, copies and taken."""
    names = [*ADDED[1:3], "whole", "cut", "inclusive"]
    cut = small(cuts.select(F.col("source").alias("__mix_source"), *[F.col(c).alias(f"__mix_{c}") for c in names]))
    more = (F.col("__mix_h") < F.col("__mix_cut")) | ((F.col("__mix_h") == F.col("__mix_cut")) & F.col("__mix_inclusive"))
    copies = (F.col("__mix_whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("int")
    out = rows.join(cut, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    added = [F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken")]
    return out.select(*quoted(c for c in rows.columns if c != "__mix_h"), *added)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size and key of every document, staged: texts are read once for all that follows."""
    return staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_key(F.col(id_col)).alias("h")), "mix-sizes")


def assign(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The table of measure() with source_size, target, copies and taken."""
    return _apply(sizes.withColumnRenamed("h", "__mix_h"), thresholds(sizes, source_targets(sizes, weights, share, most)), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with size, source_size, target, copies and taken (columns of these names are replaced, all others stay; names
    that start with `__mix_` are the operator's own).

    Null texts have size 0 and take nothing; a null source is a source of its own, last in order; documents of one id
    have one key and are taken together; an empty table gives an empty table. Within a source the words taken differ
    from the target by at most half of the last key's words.
    """
    sizes = measure(docs, id_col, text_col, source_col)
    cuts = thresholds(sizes, source_targets(sizes, weights, share, most))
    rows = without(docs, *ADDED).withColumn("size", word_count(F.col(text_col))).withColumn("__mix_h", hash_key(F.col(id_col)))
    return _apply(rows, cuts, source_col)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return assign(measure(docs)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS w FROM s),
r AS (SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
             (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS free FROM w WINDOW o AS (ORDER BY cap / w, source)),
v AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - capped) / free AS v FROM r),
l AS (SELECT arg_min(v, k) FILTER (v <= cap / w) AS level FROM v),
t AS (SELECT source, source_size, least(cap, level * w) AS target, CASE WHEN source_size > 0 THEN floor(least(cap, level * w) / source_size) ELSE 0 END AS whole FROM w, l),
c AS (SELECT source, h, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d WHERE size > 0 GROUP BY source, h),
e AS (SELECT c.source, h AS cut, (upto - (target - whole * source_size)) < (target - whole * source_size) - (upto - n) AS inclusive
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE upto > target - whole * source_size AND upto - n <= target - whole * source_size)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * (whole + CASE WHEN coalesce(h < cut OR (h = cut AND inclusive), false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
