"""Degrees of a stream of directed edges, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import directed_degrees


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema("src long, dst long").parquet(folder)


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running out_degree and in_degree of every node; write it in complete or update mode.
    Repeated edges count each time."""
    return directed_degrees(edges.where(F.col("src") != F.col("dst")))
