"""Multiple-alignment text (MAF blocks of two rows) as alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(score, target, position, query, query_position, query_length, reverse, target_aligned_length, query_aligned_length, mismatches, indels).

    A block begins with a line ``a score=...``; its first ``s`` row is the target, its
    second the query. Blocks without two rows and comments are left out.
    """
    raw = spark.read.option("lineSep", "\na ").text(path)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = F.transform(F.filter(lines, lambda x: x.startswith("s ")), lambda x: F.split(x, r"\s+"))
    score = F.regexp_extract("value", r"score=([-0-9.eE+]+)", 1)
    own = raw.select(score.alias("score"), rows.alias("rows")).where((F.size("rows") >= 2) & (F.col("score") != ""))
    target, query = F.col("rows")[0], F.col("rows")[1]
    columns = F.arrays_zip(F.split(target[6], "").alias("t"), F.split(query[6], "").alias("q"))
    count = lambda f: F.size(F.filter(columns, f))
    gap = lambda c: (c["t"] == "-") | (c["q"] == "-")
    return own.select(
        F.col("score").cast("double").alias("score"), target[1].alias("target"), target[2].cast("long").alias("position"), query[1].alias("query"), query[2].cast("long").alias("query_position"), query[5].cast("long").alias("query_length"),
        (query[4] == "-").alias("reverse"), target[3].cast("long").alias("target_aligned_length"), query[3].cast("long").alias("query_aligned_length"),
        count(lambda c: ~gap(c) & (F.upper(c["t"]) != F.upper(c["q"]))).alias("mismatches"), count(gap).alias("indels"),
    )
