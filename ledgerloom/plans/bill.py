"""A reference bill and an offer derived from the driver's lineitem and part tables, in DataFrame and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

UNITS = ("buc", "mp", "mc", "kg", "m")
#: Parts up to which Spark may broadcast them; more are joined by a shuffle, whatever their file's size promises.
PARTS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_code(part: str) -> Column:
    return F.concat(F.lit("PK"), F.lpad(F.col(part).cast("string"), 5, "0"))


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a lineitem; seq is unique and in the order of order and line, and of part, supplier and amounts where a line repeats.

    It holds up to 64 lines of an order and 4,096 repeats of a line, and any number of orders below 2^45.
    """
    li = read(spark, sf_dir, "lineitem")
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    li = li.withColumn("again", again - 1)
    seq = (F.col("l_orderkey") * 64 + F.col("l_linenumber")) * 4096 + F.col("again")
    return _items(li, read(spark, sf_dir, "part"), seq.alias("seq"))


def printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill for queries that only print it in order: `place` in place of seq, which puts the items of an order in the same order.

    Rows of one place are equal in all columns, so which comes first shows nowhere; no row is numbered, and no order is shuffled for it.
    """
    li = read(spark, sf_dir, "lineitem")
    return _items(li, read(spark, sf_dir, "part"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"))


def _items(li: DataFrame, p: DataFrame, place: Column) -> DataFrame:
    p = p if p.count() <= PARTS else p.hint("merge")
    units = F.array(*map(F.lit, UNITS))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        place, (F.col("l_orderkey") % 40).cast("string").alias("deviz"), item_code("l_partkey").alias("cod"),
        F.col("p_name").alias("denumire"), F.element_at(units, F.col("p_size") % 5 + 1).alias("um"), F.col("l_quantity").alias("cantitate"), F.col("p_brand").alias("deviz_denumire"),
        F.lit(False).alias("is_component"), F.col("p_retailprice").alias("pret_material"), F.col("l_extendedprice").alias("val_material"), "l_orderkey", "l_linenumber", "l_partkey", "p_size",
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bill(spark, sf_dir).filter((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 0)


def offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill with gaps, other quantities, other units, look-alike codes and other sections."""
    b = bill(spark, sf_dir).filter((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 10 != 1)
    part = F.col("l_partkey")
    return b.withColumns({
        "cantitate": F.when(part % 17 == 0, F.col("cantitate") + 1).otherwise(F.col("cantitate")),
        "um": F.when(part % 23 == 0, F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_size") + 1) % 5 + 1)).otherwise(F.col("um")),
        "cod": F.when(part % 29 == 0, F.translate("cod", "0", "O")).otherwise(F.col("cod")),
        "deviz": F.when(F.col("l_orderkey") % 37 == 0, (F.col("deviz").cast("int") + 100).cast("string")).otherwise(F.col("deviz")),
    })


SQL = """
WITH b AS (SELECT (l_orderkey * 64 + l_linenumber) * 4096 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq, (l_orderkey % 40)::VARCHAR AS deviz, 'PK' || lpad(l_partkey::VARCHAR, 5, '0') AS cod,
                  p_name AS denumire, ['buc', 'mp', 'mc', 'kg', 'm'][p_size % 5 + 1] AS um, l_quantity AS cantitate, p_brand AS deviz_denumire, p_retailprice AS pret_material,
                  l_extendedprice AS val_material, l_orderkey, l_linenumber, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
ref AS (SELECT * FROM b WHERE (l_orderkey + l_linenumber) % 10 <> 0),
offer AS (SELECT seq, CASE WHEN l_orderkey % 37 = 0 THEN (deviz::INT + 100)::VARCHAR ELSE deviz END AS deviz, CASE WHEN l_partkey % 29 = 0 THEN replace(cod, '0', 'O') ELSE cod END AS cod, denumire,
                 CASE WHEN l_partkey % 23 = 0 THEN ['buc', 'mp', 'mc', 'kg', 'm'][(p_size + 1) % 5 + 1] ELSE um END AS um, CASE WHEN l_partkey % 17 = 0 THEN cantitate + 1 ELSE cantitate END AS cantitate,
                 deviz_denumire, pret_material, val_material, l_orderkey, l_linenumber, l_partkey, p_size FROM b WHERE (l_orderkey * 3 + l_linenumber) % 10 <> 1),
rd AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY deviz, cod, um, cantitate ORDER BY seq) AS n FROM ref) WHERE n = 1),
od AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY deviz, cod, um, cantitate ORDER BY seq) AS n FROM offer) WHERE n = 1)
"""
