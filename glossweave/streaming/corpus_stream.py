"""The line-by-line sources as streams of files: the same expressions as for batches, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import tokens_with_marks
from glossweave.sources.readers import parse_assertions


def stream_assertions(spark: SparkSession, folder: str) -> DataFrame:
    return parse_assertions(spark.readStream.text(folder))


def stream_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(text, tokens) of the corpus lines that arrive in a folder; blank lines go."""
    return spark.readStream.text(folder).select(F.col("value").alias("text")).where(F.trim("text") != "").withColumn("tokens", tokens_with_marks(F.col("text")))
