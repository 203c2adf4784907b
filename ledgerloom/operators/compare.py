"""Comparison of matched items, arithmetic checks, and the dedup of discrepancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import compare_unit

QUANTITY = ("cantitate",)
PAIRS = tuple((f"pret_{k}", f"val_{k}") for k in ("material", "manopera", "utilaj", "transport"))
PRICES = (*(p for p, _ in PAIRS), *(v for _, v in PAIRS))
#: A numeric difference counts beyond this and beyond this part of the larger value; a product beyond one hundredth.
ABSOLUTE, RELATIVE, ARITHMETIC = 0.05, 0.005, 0.01
DIFF = "array<struct<tip:string,camp:string,ref:double,oferta:double,ref_text:string,oferta_text:string>>"
# Which discrepancy of a pair stays when several are found (larger first, all others 0).
PRIORITY = {"COD_SIMILAR": 3, "ARTICOL_ORPHAN": 2, "DIFERENTA_CAMP": 1, "UM_DIFERIT": 1}
#: Fields in the order in which a pair's differences are found.
FIELD_ORDER = ("um", *QUANTITY, *PRICES)


def field_rank(camp: str = "camp") -> Column:
    """A field's place among a pair's differences; what is no field comes last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, FIELD_ORDER)), F.coalesce(F.col(camp), F.lit(""))).cast("int"), F.lit(0)).cast("int")


def differs(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    gap = F.abs(x - y)
    return (gap > ABSOLUTE) & (gap / F.greatest(F.abs(x), F.abs(y)) >= RELATIVE)


def diffs(ref: str = "ref_", offer: str = "oferta_", prices: bool = False) -> Column:
    """The differences of a pair's row as an array: unit, quantity and, if asked for, prices and values."""
    c = lambda side, name: F.col(side + name)
    row = lambda tip, camp, r, o, rt, ot: F.struct(F.lit(tip).alias("tip"), F.lit(camp).alias("camp"), r.alias("ref"), o.alias("oferta"), rt.alias("ref_text"), ot.alias("oferta_text"))
    no, nos = F.lit(None).cast("double"), F.lit(None).cast("string")
    out = [F.when(compare_unit(c(ref, "um")) != compare_unit(c(offer, "um")), row("UM_DIFERIT", "um", no, no, c(ref, "um"), c(offer, "um")))]
    for name in QUANTITY + (PRICES if prices else ()):
        x, y = F.coalesce(c(ref, name), F.lit(0.0)), F.coalesce(c(offer, name), F.lit(0.0))
        out.append(F.when(differs(x, y), row("DIFERENTA_CAMP", name, x, y, nos, nos)))
    return F.filter(F.array(*out), lambda x: x.isNotNull()).cast(DIFF)


def lenient(found: Column, is_component: Column, quantity: Column, unit: Column) -> Column:
    """Differences of unit and quantity are no discrepancy for a component that lacks either."""
    partial = F.coalesce(is_component, F.lit(False)) & ((F.coalesce(quantity, F.lit(0.0)) == 0) | (F.trim(F.coalesce(unit, F.lit(""))) == ""))
    return F.when(partial, F.filter(found, lambda x: ~x["camp"].isin("um", "cantitate"))).otherwise(found)


def round2(c: Column) -> Column:
    """Two decimals, halves up, on both sides of zero alike for what items hold."""
    return F.floor(c * 100 + 0.5) / 100


def arithmetic(prefix: str = "", columns: list[str] | None = None) -> Column:
    """camp, calculat and declarat of each value that is not quantity times price within a hundredth, as an array; a column missing from `columns` has none."""
    rows = []
    for price, value in PAIRS:
        if columns is None or (price in columns and value in columns):
            p, v = F.coalesce(F.col(prefix + price), F.lit(0.0)), F.coalesce(F.col(prefix + value), F.lit(0.0))
            want = round2(F.coalesce(F.col(prefix + "cantitate"), F.lit(0.0)) * p)
            gap = F.abs(v - want)
            bad = (p > 0) & (v > 0) & (want > 0) & (gap > ABSOLUTE) & (gap / F.greatest(v, want) > ARITHMETIC)
            rows.append(F.when(bad, F.struct(F.lit(value).alias("camp"), want.alias("calculat"), v.alias("declarat"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def arithmetic_errors(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tip, camp, calculat and declarat of the items' arithmetic errors."""
    return items.withColumn("__e", F.explode(arithmetic(columns=items.columns))).select(*keys, F.lit("EROARE_ARITMETICA").alias("tip"), "__e.*")


def dedup_discrepancies(rows: DataFrame, order: list, scope: list[str] | None = None) -> DataFrame:
    """One discrepancy for each (ref_cod, oferta_cod), that of the highest priority and then the first; `scope` adds columns to the key."""
    prio = F.lit(0)
    for tip, p in PRIORITY.items():
        prio = F.when(F.col("tip") == tip, p).otherwise(prio)
    w = Window.partitionBy(*(scope or []), "ref_cod", "oferta_cod").orderBy(prio.desc(), *order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_differences(ref: DataFrame, offer: DataFrame, keys: list[str]) -> DataFrame:
    """ref_cod, oferta_cod, ref_seq, oferta_seq, tip and camp: for each pair of codes its first difference of unit or quantity, by the ordinals of both sides, among rows of equal `keys`.

    Sides have keys, seq, cod, um and cantitate. This is what dedup_discrepancies() leaves of diffs() over the join, without
    the join: a reference row differs from some offer row of its key if and only if it differs from one of the extremes in
    unit or quantity, as a quantity that counts as different stays so the farther it lies. So the first such row of each pair
    of codes is found from the extremes, and only that one meets its offer rows.
    """
    unit = compare_unit("um")
    side = lambda rows, p: rows.select(*keys, *[F.col(c).alias(p + c) for c in ("seq", "cod", "um", "cantitate")])
    q = F.coalesce("cantitate", F.lit(0.0))
    ends = offer.groupBy(*keys, F.col("cod").alias("oferta_cod")).agg(F.min(unit).alias("__u"), F.max(unit).alias("__v"), F.min(q).alias("__a"), F.max(q).alias("__b"))
    own, value = compare_unit("ref_um"), F.col("ref_cantitate")
    hit = side(ref, "ref_").join(ends, keys).filter((own != F.col("__u")) | (own != F.col("__v")) | differs(value, F.col("__a")) | differs(value, F.col("__b")))
    fields = [*keys, *[f"ref_{c}" for c in ("seq", "cod", "um", "cantitate")]]
    first = hit.groupBy("ref_cod", "oferta_cod").agg(F.min_by(F.struct(*[c for c in fields if c != "ref_cod"]), "ref_seq").alias("x")).select("ref_cod", "oferta_cod", "x.*")
    near = first.withColumnRenamed("oferta_cod", "__oc").join(side(offer, "oferta_"), keys).filter(F.col("__oc").eqNullSafe(F.col("oferta_cod")))
    found = near.select("ref_cod", "oferta_cod", "ref_seq", "oferta_seq", F.explode(diffs()).alias("d"))
    best = found.groupBy("ref_cod", "oferta_cod").agg(F.min_by(F.struct("ref_seq", "oferta_seq", "d.tip", "d.camp"), F.struct("ref_seq", "oferta_seq", field_rank("d.camp").alias("k"))).alias("x"))
    return best.select("ref_cod", "oferta_cod", "x.*")
