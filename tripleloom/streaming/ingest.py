"""Assertions as a stream: late repeats are dropped within a watermark, batches are appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ASSERTIONS = "s string, p string, o string, asserted_at timestamp"


def assertions(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """A stream of the JSON-lines files that arrive in ``folder``, each assertion once within the watermark."""
    raw = spark.readStream.schema(ASSERTIONS).json(folder)
    return raw.withWatermark("asserted_at", late).dropDuplicatesWithinWatermark(["s", "p", "o"])


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Assertions per predicate and window."""
    return stream.withWatermark("asserted_at", late).groupBy(F.window("asserted_at", every), "p").agg(F.count("*").alias("n"))
