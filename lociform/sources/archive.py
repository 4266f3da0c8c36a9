"""Stores of several data sets under one path: step functions with totals, and reads in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(members: dict[str, DataFrame], path: str, key: str = "target") -> None:
    """Step functions (key, start, length, count) by name, in order, and the totals of each."""
    spark = next(iter(members.values())).sparkSession
    for name, steps in members.items():
        runs = steps.select(F.col(key).cast("string").alias("target"), "start", "length", "count")
        runs.repartitionByRange("target", "start").sortWithinPartitions("target", "start").write.mode("overwrite").parquet(f"{path}/runs/member={name}")
    totals = spark.read.parquet(f"{path}/runs").groupBy("member", "target").agg(F.sum("length").alias("sites"), F.sum(F.col("length") * F.col("count")).alias("bases"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")  # one row for each member and target


def members(spark: SparkSession, path: str) -> DataFrame:
    """(member) of an archive, sorted."""
    return spark.read.parquet(f"{path}/totals").select("member").distinct().orderBy("member")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(member, target, sites, bases); the runs aren't read."""
    return spark.read.parquet(f"{path}/totals")


def read_counts(spark: SparkSession, path: str, member: str, target: str | None = None) -> DataFrame:
    """(target, start, length, count) of one member; other members' files aren't opened."""
    runs = spark.read.parquet(f"{path}/runs").where(F.col("member") == member).drop("member")
    return runs if target is None else runs.where(F.col("target") == target)


def shared_targets(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(target) that all of some members hold."""
    own = totals(spark, path).where(F.col("member").isin(names))
    return own.groupBy("target").agg(F.count_distinct("member").alias("n")).where(F.col("n") == len(set(names))).select("target")


def write_reads(reads: DataFrame, path: str, index: str, rows_a_file: int = 0) -> None:
    """Reads in the order of their index, so that a slice opens only files and row groups that hold it."""
    reads.repartitionByRange(index).sortWithinPartitions(index).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def read_reads(spark: SparkSession, path: str, index: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """All reads, or those with start <= index < end."""
    reads = spark.read.parquet(path)
    if start is not None:
        reads = reads.where(F.col(index) >= start)
    return reads if end is None else reads.where(F.col(index) < end)
