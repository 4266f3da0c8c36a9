"""Step functions as track files: bedGraph and fixed-step wiggle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bedgraph_rows(steps: DataFrame, key: str) -> DataFrame:
    """(chrom, chromStart, chromEnd, value) of the runs that are not 0."""
    return steps.where("count != 0").select(F.col(key).alias("chrom"), F.col("start").alias("chromStart"), (F.col("start") + F.col("length")).alias("chromEnd"), F.col("count").alias("value"))


def write_bedgraph(steps: DataFrame, key: str, path: str) -> None:
    """Tab-separated text, in order of key and start."""
    rows = bedgraph_rows(steps, key).orderBy("chrom", "chromStart")
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_wiggle(bins: DataFrame, key: str, path: str, resolution: int) -> None:
    """variableStep text of (key, start, mean), 1-based, one file for each partition of the key's order."""
    lines = bins.withColumn("__n", F.row_number().over(_by(key)))
    head = F.concat(F.lit("variableStep chrom="), F.col(key).cast("string"), F.lit(f" span={resolution}\n"))
    line = F.concat(F.when(F.col("__n") == 1, head).otherwise(""), (F.col("start") + 1).cast("string"), F.lit(" "), F.format_number("mean", 3))
    lines.repartitionByRange(key, "start").sortWithinPartitions(key, "start").select(line.alias("value")).write.mode("overwrite").text(path)


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("start")


def read_bedgraph(spark, path: str) -> DataFrame:
    """(chrom, start, length, count) of a bedGraph text; track and comment lines are left out."""
    text = spark.read.text(path).where("NOT value RLIKE '^(track|browser|#)'")
    f = F.split("value", "\\s+")
    return text.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), (f[2].cast("long") - f[1].cast("long")).alias("length"), f[3].cast("double").alias("count"))
