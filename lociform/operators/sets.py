"""Unions, differences and comparisons of data sets; ordering for storage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.scratch import stored

#: Rows of a sorted range.
RANGE = 1_000_000


def concatenated(parts: Sequence[DataFrame], source: str = "source") -> DataFrame:
    """Bag union with the number of the part that a row is from."""
    return reduce(DataFrame.unionByName, (p.withColumn(source, F.lit(i)) for i, p in enumerate(parts)))


def schema_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of rows and of columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def diff(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, class) with one row for each key of unique-keyed inputs: ``only_a``, ``only_b``, the first column that differs, or ``same``."""
    left = a.select(F.col(key).alias("__a"), *(F.col(c).alias(f"__a_{c}") for c in columns))
    right = b.select(F.col(key).alias("__b"), *(F.col(c).alias(f"__b_{c}") for c in columns))
    kind = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b")
    for c in columns:
        kind = kind.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), c)
    return left.join(right, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), kind.otherwise("same").alias("class"))


def compare_calls(truth: DataFrame, calls: DataFrame, keys: list[str], alleles: str) -> DataFrame:
    """Positions of both with the class of their disagreement."""
    both = truth.select(*keys, F.col(alleles).alias("__t")).join(calls.select(*keys, F.col(alleles).alias("__c")), keys)
    missed, extra = F.size(F.array_except("__t", "__c")), F.size(F.array_except("__c", "__t"))
    kind = F.when((missed == 0) & (extra == 0), "agree").when(missed == 1, "missed_one").when(missed == 2, "missed_two").when(missed > 2, "missed_more").otherwise("other")
    return both.select(*keys, missed.alias("missed"), extra.alias("extra"), kind.alias("class"))


def transition(ref: str, alt: str):
    """Whether a substitution is a transition, for ti/tv."""
    return F.concat(F.least(F.upper(ref), F.upper(alt)), F.greatest(F.upper(ref), F.upper(alt))).isin("AG", "CT")


def paired(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of both sides that share a key, side by side."""
    pick = lambda df, s: df.select(key, *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return pick(a, "a").join(pick(b, "b"), key)


def indexed(df: DataFrame, name: str, index: str) -> DataFrame:
    """``df`` with dense indices of a name's sorted distinct values.

    The distinct values are ranged over partitions and numbered by partition counts, so
    no task orders all of them. Rows whose name is null have no index and are left out.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct().repartitionByRange(name).sortWithinPartitions(name)
    # written before the counts: a range may be cut differently when it is computed again
    numbered = stored(names.select(name, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i")))
    sizes = numbered.groupBy("__p").agg(F.count("*").alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    return df.join(numbered.join(F.broadcast(offsets), "__p").select(name, (F.col("__before") + F.col("__i")).alias(index)), name)


def spread(df: DataFrame, group: str, order: str, parts: int) -> DataFrame:
    """``df`` with a part number such that rows of one group go to different parts in turn (U8)."""
    return df.withColumn("part", (F.row_number().over(W.partitionBy(group).orderBy(order)) - 1).cast("long") % parts)


def set_union(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Read sets added up by multiplicity."""
    return reduce(DataFrame.unionByName, sets).groupBy(key).agg(F.sum("multiplicity").alias("multiplicity"))


def write_sorted(df: DataFrame, keys: Sequence[str], path: str, rows_a_file: int = 0) -> None:
    """Parquet in the order of ``keys``: ranges over files, sorted inside, so footers prune seeks.

    There are as many ranges as keep one at about ``RANGE`` rows; left to itself, Spark joins
    ranges by their compressed size, which says little of the memory that sorting them takes.
    """
    df.repartitionByRange(df.count() // RANGE + 1, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def with_origins(df: DataFrame, source: str, origin: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with origins numbered anew over all sources, and attributes that are set for all.

    The table of origins, a row for each read group of a source, is ordered in one task.
    """
    groups = df.select(source, origin).distinct()
    new = groups.withColumn("__new", (F.dense_rank().over(W.orderBy(source, origin)) - 1).cast("long"))
    out = df.join(new, [source, origin]).drop(origin).withColumnRenamed("__new", origin)
    return out.withColumns({n: F.lit(v) for n, v in (attributes or {}).items()})
