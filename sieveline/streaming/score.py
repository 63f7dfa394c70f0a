"""An extension: the signals and scores of a stream of messages, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import signals


def read_messages(spark: SparkSession, path: str, schema: str = "doc long, text string") -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def signal_scores(messages: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """doc, score by the signals alone: one projection, so it runs on streams and tables alike."""
    made = signals.with_signals(messages.select("doc", "text"))
    z = sum((F.col(c) * w for c, w in weights.items()), F.lit(float(intercept)))
    return made.select("doc", (1 / (1 + F.exp(-z))).alias("score"))
