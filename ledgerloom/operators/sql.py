"""The engine's rules as SQL functions, and progress while tables are staged."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..session import staged
from . import parser


def register_rules(spark: SparkSession) -> None:
    """name_ratio, code_ratio, text_ratio, token_score and description_ratio (reference or first text, then the other), and the table function parse_lines."""
    similarity.register(spark)
    parser.register(spark)


def watched(tell: Callable[[str, int, float], None], persist=staged):
    """A `persist` for the drivers that tells name, rows and seconds of every table as it is staged; the rows are counted while they are written."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        seen, start = Observation(), time.time()
        out = persist(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        tell(name, seen.get["n"], time.time() - start)
        return out

    return keep
