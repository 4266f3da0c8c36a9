"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the session names; a local one only on a local master."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if not set_.isEmpty():
        return set_.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or tempfile.mkdtemp(prefix="lociform-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as it was computed once, its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing lies at."""
    return f"{folder(spark)}/lociform-{uuid.uuid4().hex}"
