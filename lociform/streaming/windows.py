"""Streaming forms of the ordered operators (2.10), on Structured Streaming.

Every function takes a batch or a streaming DataFrame; with a batch the watermark has no
effect, so both give the same rows once a stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, keys: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by fixed windows."""
    got = df.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, keys: list[str], width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Counts by overlapping windows."""
    got = df.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of rows less than ``gap`` apart, as peaks are runs of sites."""
    got = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return got.select(*keys, "first", "last", "n")


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key, forgotten behind the watermark if the input is a stream."""
    own = df.withWatermark(ts, late)
    return own.dropDuplicatesWithinWatermark(keys) if df.isStreaming else own.dropDuplicates(keys)


def lateness(df: DataFrame, ts: str, arrival: str, allowed: int) -> DataFrame:
    """``df`` with ``is_late``: the row comes more than ``allowed`` seconds after its time; late rows are marked, not dropped."""
    return df.withColumn("is_late", F.unix_seconds(arrival) - F.unix_seconds(ts) > allowed)


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming plan over what is there and returns the rows of its memory table."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)
