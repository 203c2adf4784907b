"""Sources: OCR documents, offer discovery, checkpoints, pattern libraries, expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "pages array<struct<page_number:int,lines:array<struct<content:string>>>>, tables array<struct<row_count:int,column_count:int,cells:array<struct<row_index:int,column_index:int,content:string>>>>"


# The built-in library of layouts.
PATTERNS = [
    ("MANECIU", [r"^\d+\s+[A-Z0-9]+"], [(r"^L:\s*[A-Z0-9]+\s+-", "prefix")], "inherit_from_parent"),
    ("DRAGOMIRESTI", [r"^\d+\s+[A-Z0-9]+"], [(r"^\d+\.\d+\s+", "hierarchy")], "inherit_from_parent"),
]


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (the file's name without ending), pages and tables; missing ones are empty."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(paths).withColumn("file", F.col("_metadata.file_name"))
    return d.select(F.regexp_replace("file", r"\.json$", "").alias("doc_id"), F.coalesce("pages", F.array().cast(d.schema["pages"].dataType)).alias("pages"), F.coalesce("tables", F.array().cast(d.schema["tables"].dataType)).alias("tables"))


def offers(docs: DataFrame) -> DataFrame:
    """Documents named di_oferta_N, with offer_nr, in order of their names; others are left out."""
    n = F.regexp_extract("doc_id", r"^di_oferta_(.+)$", 1).try_cast("int")
    return docs.withColumn("offer_nr", n).filter("offer_nr is not null").orderBy("doc_id")


def reference(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id = 'di_referinta'")


def checkpoint(spark: SparkSession, path: str, rules: str) -> DataFrame | None:
    """The table written under these rules, None if there is none."""
    from .sinks import checkpoint_path

    try:
        return spark.read.parquet(checkpoint_path(path, rules))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def patterns(spark: SparkSession, path: str | None = None) -> DataFrame:
    """name, parent_indicators, component_indicators and quantity_rule; the built-in library without a file."""
    schema = "name string, parent_indicators array<string>, component_indicators array<struct<pattern:string,type:string>>, quantity_rule string"
    if path is None:
        return spark.createDataFrame(PATTERNS, schema)
    d = spark.read.schema(f"patterns array<struct<{schema.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>>").option("multiLine", True).json(path)
    return d.select(F.inline("patterns"))


def pattern_by_name(library: DataFrame, name: str) -> DataFrame:
    """The row of a pattern, none where the library has none of that name."""
    return library.filter(F.col("name") == name)


def first_checkpoint(spark: SparkSession, paths: list[str], rules: str) -> DataFrame | None:
    """The first of several checkpoints that was written under these rules, such as a section map's beside the reference's; None without any."""
    return next((t for t in (checkpoint(spark, p, rules) for p in paths) if t is not None), None)


def expected_items(spark: SparkSession, path: str) -> DataFrame:
    """code and description from lines CODE|DESCRIPTION; comments and malformed lines are left out."""
    t = spark.read.text(path).filter(~F.trim("value").startswith("#") & F.col("value").contains("|"))
    p = F.split("value", r"\|", 2)
    return t.select(F.upper(F.trim(p[0])).alias("code"), F.trim(p[1]).alias("description")).filter("code <> ''")
