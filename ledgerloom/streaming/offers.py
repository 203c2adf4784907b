"""Structured Streaming of offers as they arrive: not part of batch results, the same operators on each new file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "offer_nr int, seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean, arrived timestamp"


def incoming(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """Item rows of offers from JSON files in a folder; an offer's row that arrives again within a day is dropped."""
    rows = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files).json(path)
    return rows.withWatermark("arrived", "1 day").withColumn("content", F.xxhash64("offer_nr", "deviz", "cod", "um", "cantitate", "seq")).dropDuplicatesWithinWatermark(["offer_nr", "content"])


def compare_arrivals(offers: DataFrame, reference: DataFrame, out: str, checkpoint: str, compare: Callable[[DataFrame, DataFrame], DataFrame]):
    """Starts a query that compares each batch's offers with the reference and appends the result to a table of files."""

    def each(batch: DataFrame, epoch: int) -> None:
        compare(reference, batch.drop("content")).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return offers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(offers: DataFrame, window: str = "10 minutes") -> DataFrame:
    return offers.groupBy(F.window("arrived", window), "offer_nr").agg(F.count("*").alias("n"))
