"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import checkpointed

#: Most edges that one task contracts at a time.
EDGES_A_TASK = 250_000


def contracted(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """node -> smallest node of its component, for nodes that are not it."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (y := up.get(at, at)) != at:
            at = y
        while (y := up.get(x, x)) != at:
            up[x] = at
            x = y
        return at

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = contracted((a, b) for batch in batches for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], names=["hi", "lo"])

    return edges.mapInArrow(run, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for each end of an edge that is not its component's smallest id.

    ``edges`` is read twice and has two columns of ids; loops, repeated edges and rows with a null are
    allowed and change nothing. Each task first contracts a bounded share of the edges
    to a forest; large-star and small-star rounds then join the forests until every
    edge leads to the smallest id.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(_contract(e.repartition(1 + e.count() // EDGES_A_TASK)))
    if e.rdd.getNumPartitions() == 1:
        return e.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    seen = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpointed(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
        seen = now
