"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one named by ``spark.checkpoint.dir``; a local one is set only where
    a session on one machine names none, as in tests, and a cluster without one is refused.
    Partitions are left as they are: those of scans and of adaptive shuffles follow the bytes.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lociform-checkpoint-"))
    return df.checkpoint(eager=True)


#: A batch is cut into parts of at most so many bytes and rows, so that what is made of long texts stays small.
PART_BYTES, PART_ROWS = 4 << 20, 2048


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch; a slice holds one row at least."""
    sizes = sum((np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)), np.zeros(batch.num_rows, np.int64))
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART_BYTES, "right"))
        end = max(at + 1, min(full, at + PART_ROWS))
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Arrow batches through ``rows``: lists by column in, lists by column out."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    out = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                got = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; a null text is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
