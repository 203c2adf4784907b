"""First-wins dedups with an explicit order, and the removal of code fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def last_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    return first_by(rows, keys, [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])


def dedup_extraction(items: DataFrame, order: list, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row for each code (in upper case), section and quantity, within `scope`."""
    return first_by(items, [*scope, F.upper("cod"), "deviz", "cantitate"], order)


def dedup_items(items: DataFrame, order: list, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row for each section, code, unit and quantity, within `scope`."""
    return first_by(items, [*scope, "deviz", "cod", "um", "cantitate"], order)


def _bare(c: str) -> Column:
    return F.regexp_replace(F.upper(F.col(c)), r"^\$", "")


def _drop_near_suffixes(items: DataFrame, order: str, scope: tuple[str, ...]) -> DataFrame:
    """drop_code_suffixes() over rows that lie together by `scope`, such as a document's, without joins.

    Read backwards, an end is a beginning, and in order of such texts a code that begins another begins the next different
    one: each pass is one sort, and no end is spread out.
    """

    def ends(after: str) -> Column:
        """Whether the row's code is a proper end of the one that comes next, read backwards."""
        return F.coalesce((F.col("__r") != "") & F.col(after).startswith(F.col("__r")) & (F.length(after) > F.length("__r")), F.lit(False))

    base = items.withColumn("__r", F.reverse(_bare("cod")))
    near = Window.partitionBy(*scope, "deviz", "cantitate", "um").orderBy("__r", order)
    # equal codes stand side by side, those without a code as one
    again = (F.row_number().over(near) > 1) & F.lag("__r").over(near).eqNullSafe(F.col("__r"))
    base = base.withColumn("__again", again).filter(~F.col("__again") | (F.coalesce("__r", F.lit("-")) == ""))
    base = base.withColumn("__after", F.lead("__r").over(near)).filter(~ends("__after"))
    wide = Window.partitionBy(*scope, "deviz").orderBy("__r")
    after = F.lead("__r").over(wide)
    base = base.withColumn("__after", F.when(after != F.col("__r"), after))
    base = base.withColumn("__after", F.max("__after").over(Window.partitionBy(*scope, "deviz", "__r")))
    numeric = F.coalesce(F.col("__r").rlike(r"^\d{4,9}$"), F.lit(False))
    return base.filter(~(numeric & ends("__after"))).select(*items.columns)


def drop_code_suffixes(items: DataFrame, order: str = "seq", scope: tuple[str, ...] = ()) -> DataFrame:
    """Drops codes that are the end of another's, within `scope`.

    First among rows of one section, quantity and unit (of equal codes the later row goes); then, over what is left,
    numeric ends of 4 to 9 digits among all rows of a section. Only the proper ends of distinct codes are spread out,
    those of 4 to 9 digits in the second pass, so each is an equi-join and no comparison of all pairs. With a scope its rows
    are sorted where they lie instead.
    """
    if scope:
        return _drop_near_suffixes(items, order, scope)

    def without_ends(rows: DataFrame, keys: list[str], numeric: bool) -> DataFrame:
        base = rows.withColumn("__c", _bare("cod"))
        if not numeric:
            first = Window.partitionBy(*keys, "__c").orderBy(order)
            base = base.withColumn("__n", F.row_number().over(first)).filter("__n = 1 OR __c = ''").drop("__n")
        least, most = (4, 9) if numeric else (1, 1 << 30)
        ends = base.select(*[F.col(k).alias("__" + k) for k in keys], "__c").distinct()
        ends = ends.withColumn("__end", F.explode(F.expr(f"CASE WHEN length(__c) > {least} THEN transform(sequence(greatest(2, length(__c) - {most} + 1), length(__c) - {least} + 1), i -> substring(__c, i)) END")))
        if numeric:
            ends = ends.filter(F.col("__end").rlike(r"^\d{4,9}$"))
        ends = ends.drop("__c").distinct()
        on = F.col("__end") == F.col("__c")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col("__" + k))
        return base.join(ends, on, "left_anti").drop("__c")

    return without_ends(without_ends(items, ["deviz", "cantitate", "um"], False), ["deviz"], True)


def drop_code_fragments(items: DataFrame) -> DataFrame:
    """Drops numeric codes that a longer one of the section holds, and 4-digit codes that share three digits with the start or end of one of 6 or more."""
    codes = items.select("deviz", _bare("cod").alias("c")).filter("c rlike '^[0-9]{4,9}$'").distinct()
    parts = codes.select("deviz", F.col("c").alias("whole"), F.explode(F.expr("flatten(transform(sequence(1, length(c)), i -> transform(sequence(4, greatest(4, length(c) - i + 1)), n -> substring(c, i, n))))")).alias("c")).filter("length(c) < length(whole) and length(c) >= 4")
    edges = codes.filter("length(c) >= 6").select("deviz", F.explode(F.array(F.concat(F.lit("a"), F.substring("c", 1, 3)), F.concat(F.lit("z"), F.expr("right(c, 3)")))).alias("edge"))
    four = codes.filter("length(c) = 4").select("deviz", "c", F.explode(F.array(F.concat(F.lit("a"), F.substring("c", 1, 3)), F.concat(F.lit("z"), F.expr("right(c, 3)")))).alias("edge"))
    bad = parts.select("deviz", "c").union(four.join(edges, ["deviz", "edge"], "left_semi").select("deviz", "c")).distinct().withColumnRenamed("c", "__c")
    return items.withColumn("__c", _bare("cod")).join(bad, ["deviz", "__c"], "left_anti").select(*items.columns)


def distinct_components(rows: DataFrame, order: list) -> DataFrame:
    return first_by(rows, ["doc_id", "page_number", "cod"], order)
