"""Ordered sums, as-of values and neighbours along a coordinate, in two levels.

A plain window over one key puts all of the key's rows into one task. Here the axis is
cut into blocks: sums over blocks give each block its start, and inside a block a window
does the rest, so a long axis or a hot key is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions in a block.
WIDTH = 1 << 16


def block_of(pos: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(pos) / width)


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], width: int = WIDTH) -> DataFrame:
    """``df`` with a column for each of ``values`` (new name: summed column): the sum over all
    rows of the same keys up to and with those of the same order values.

    The first of ``order`` is the numeric position; nulls in a summed column count 0.
    """
    b = df.withColumn("__blk", block_of(order[0], width))
    sums = b.groupBy(*keys, "__blk").agg(*(F.sum(v).alias(f"__s_{n}") for n, v in values.items()))
    before = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "__blk", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values))
    inside = W.partitionBy(*keys, "__blk").orderBy(*order).rangeBetween(W.unboundedPreceding, 0)
    own = b.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in values.items()))
    out = own.join(starts, [*keys, "__blk"])
    return out.select(*df.columns, *((F.col(n) + F.col(f"__s_{n}")).alias(n) for n in values))


def with_next(df: DataFrame, keys: list[str], pos: str, name: str = "next_pos", width: int = WIDTH) -> DataFrame:
    """``df`` with the next larger position of the same keys; positions are unique within keys."""
    b = df.withColumn("__blk", block_of(pos, width))
    firsts = b.groupBy(*keys, "__blk").agg(F.min(pos).alias("__first"))
    follow = firsts.select(*keys, "__blk", F.lead("__first").over(W.partitionBy(*keys).orderBy("__blk")).alias("__next"))
    inside = F.lead(pos).over(W.partitionBy(*keys, "__blk").orderBy(pos))
    return b.withColumn("__in", inside).join(follow, [*keys, "__blk"]).select(*df.columns, F.coalesce("__in", "__next").alias(name))


def latest(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the last non-null ``value`` of the same keys at or before each row's order values."""
    b = df.withColumn("__blk", block_of(order[0], width)).withColumn("__v", value)
    last = b.where(F.col("__v").isNotNull()).groupBy(*keys, "__blk").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    every = b.select(*keys, "__blk").distinct().join(last, [*keys, "__blk"], "left")
    before = F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1))
    carried = every.select(*keys, "__blk", before.alias("__carried"))
    inside = F.last("__v", ignorenulls=True).over(W.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("__in", inside).join(carried, [*keys, "__blk"]).select(*df.columns, F.coalesce("__in", "__carried").alias(name))


def swept(df: DataFrame, keys: list[str], pos: str, values: dict[str, str], name: str = "next_pos", width: int = WIDTH) -> DataFrame:
    """``running_sum`` and ``with_next`` of unique positions in one blocked pass."""
    b = df.withColumn("__blk", block_of(pos, width))
    sums = b.groupBy(*keys, "__blk").agg(F.min(pos).alias("__first"), *(F.sum(v).alias(f"__s_{n}") for n, v in values.items()))
    along = W.partitionBy(*keys).orderBy("__blk")
    upto = along.rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "__blk", F.lead("__first").over(along).alias("__next"), *(F.coalesce(F.sum(f"__s_{n}").over(upto), F.lit(0)).alias(f"__s_{n}") for n in values))
    inside = W.partitionBy(*keys, "__blk").orderBy(pos)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    own = b.select("*", F.lead(pos).over(inside).alias("__in"), *(F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(n) for n, v in values.items()))
    out = own.join(starts, [*keys, "__blk"])
    return out.select(*df.columns, F.coalesce("__in", "__next").alias(name), *((F.col(n) + F.col(f"__s_{n}")).alias(n) for n in values))


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``value`` of the row before in ``order``, null for the first row of the keys."""
    b = df.withColumn("__blk", block_of(order[0], width)).withColumn("__v", F.struct(value.alias("v")))
    last = b.groupBy(*keys, "__blk").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__blk", F.lag("__last").over(W.partitionBy(*keys).orderBy("__blk")).alias("__carried"))
    inside = F.lag("__v").over(W.partitionBy(*keys, "__blk").orderBy(*order))
    return b.withColumn("__in", inside).join(carried, [*keys, "__blk"]).select(*df.columns, F.coalesce("__in", "__carried")["v"].alias(name))


def largest_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the largest ``value`` of all rows before in ``order``, null for the first row of the keys."""
    b = df.withColumn("__blk", block_of(order[0], width))
    most = b.groupBy(*keys, "__blk").agg(F.max(value).alias("__most"))
    upto = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    carried = most.select(*keys, "__blk", F.max("__most").over(upto).alias("__carried"))
    inside = F.max(value).over(W.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return b.withColumn("__in", inside).join(carried, [*keys, "__blk"]).select(*df.columns, F.greatest("__in", "__carried").alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "__island", width: int = WIDTH) -> DataFrame:
    """``df`` with a number that grows by one at every row for which ``new`` is true."""
    return running_sum(df.withColumn("__new", new.cast("long")), keys, order, {name: "__new"}, width).drop("__new")


def reaching(df: DataFrame, keys: list[str], pos: str, distance: int) -> DataFrame:
    """``df`` with ``__blk`` and ``__own``: each row in its block of ``distance`` positions and, as a row of the
    past, in the next, so that a window over a block sees all rows up to ``distance`` before its own rows."""
    blk = F.floor(F.col(pos) / F.lit(max(distance, 1)))
    each = F.explode(F.array(F.struct(blk.alias("b"), F.lit(True).alias("own")), F.struct((blk + 1).alias("b"), F.lit(False).alias("own")))).alias("__x")
    return df.select("*", each).select(*df.columns, F.col("__x.b").alias("__blk"), F.col("__x.own").alias("__own"))
