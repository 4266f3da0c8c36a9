"""A stream run to its end gives the rows of the batch."""

import os

import pytest
from pyspark.sql import functions as F

from lociform.streaming import windows as sw

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture
def both(spark, tmp_path):
    batch = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("plan", ["tumbling", "sliding", "sessions"])
def test_stream_equals_batch(both, tmp_path, plan):
    batch, stream = both
    f = {
        "tumbling": lambda df: sw.tumbling(df, "ts", ["event_type"], "1 day", "1 minute").select("start", "event_type", "n"),
        "sliding": lambda df: sw.sliding(df, "ts", ["event_type"], "1 day", "6 hours", "1 minute"),
        "sessions": lambda df: sw.sessions(df, "ts", ["user_id"], "6 hours", "1 minute"),
    }[plan]
    got = sw.run_to_end(f(stream), f"out_{plan}", "complete" if plan != "sessions" else "append", str(tmp_path / "cp"))
    want = {tuple(r) for r in f(batch).collect()}
    have = {tuple(r) for r in got.collect()}
    assert have == want if plan != "sessions" else have <= want and have


def test_stream_dedupe(both, tmp_path):
    batch, stream = both
    got = sw.run_to_end(sw.deduplicated(stream, "ts", ["event_id"], "60 days"), "out_dedupe", "append", str(tmp_path / "cp"))
    assert got.count() == batch.select("event_id").distinct().count()
