"""Tables in the roles that operators expect, for Spark and, as CTEs, for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "DATE '1992-01-01'"


def days(c: str) -> Column:
    return F.date_diff(F.col(c).cast("date"), F.expr(DAY)).cast("long")


class Tables:
    """The tables under one folder; attributes are role bindings."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def aln(self) -> DataFrame:
        """Reads placed on a target."""
        start = days("l_shipdate")
        return self["lineitem"].select(
            (F.col("l_suppkey") % 10).alias("target"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_orderkey").alias("query"), F.col("l_linenumber").cast("long").alias("number"),
            F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("strand"), F.col("l_returnflag").alias("sample"), F.col("l_discount").alias("discount"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("length"),
        )

    @cached_property
    def ann(self) -> DataFrame:
        """Segments of genes."""
        start = days("o_orderdate")
        return self["orders"].select((F.col("o_custkey") % 10).alias("target"), start.alias("start"), (start + 30).alias("end"), F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("segment"))

    @cached_property
    def exons(self) -> DataFrame:
        """Short segments of genes."""
        start = days("o_orderdate")
        return self["orders"].select((F.col("o_custkey") % 10).alias("target"), start.alias("start"), (start + 3).alias("end"), (F.col("o_custkey") % 500).alias("gene"))

    @cached_property
    def far(self) -> DataFrame:
        """Reads on a long axis, over many blocks of the sweeps."""
        start = F.col("start") * 50021 + F.col("part")
        return self.aln.select((F.col("target") % 3).alias("target"), start.alias("start"), (start + F.col("length") * 2003).alias("end"), (start + F.col("length") * 3).alias("near_end"), "query", "number")

    @property
    def thin(self) -> DataFrame:
        """The same with short reads, most of which lie apart."""
        return self.far.select("target", "start", F.col("near_end").alias("end"))

    @cached_property
    def obs(self) -> DataFrame:
        """Bases seen at sites."""
        return self["lineitem"].select(
            F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("sample"), F.when(F.col("l_returnflag") == "N", "B").otherwise("A").alias("grp"), (F.col("l_linenumber") % 4).cast("long").alias("allele"),
            F.col("l_linestatus").alias("strand"), F.col("l_quantity").cast("long").alias("quality"), F.col("l_orderkey").alias("read"), (F.col("l_orderkey") % 50).alias("read_index"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """Ordered sites of a target."""
        return self["events"].select(F.col("event_type").alias("target"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), F.col("value"), F.col("event_id").alias("id"), F.col("user_id"))

    @cached_property
    def matrix(self) -> DataFrame:
        """Counts of elements in samples."""
        joined = self["lineitem"].join(self["part"], F.col("l_partkey") == F.col("p_partkey"))
        return joined.groupBy(F.col("p_brand").alias("element"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.count("*").alias("count"), F.sum("p_size").cast("long").alias("length"))


ALN = f"""aln AS (SELECT l_suppkey % 10 AS target, CAST(date_diff('day', {DAY}, CAST(l_shipdate AS DATE)) AS BIGINT) AS start,
  CAST(date_diff('day', {DAY}, CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS "end", l_orderkey AS query, CAST(l_linenumber AS BIGINT) AS number,
  l_extendedprice AS score, l_linestatus AS strand, l_returnflag AS sample, l_discount AS discount, l_partkey AS part, CAST(l_quantity AS BIGINT) AS length FROM lineitem)"""
ANN = f"""ann AS (SELECT o_custkey % 10 AS target, CAST(date_diff('day', {DAY}, CAST(o_orderdate AS DATE)) AS BIGINT) AS start,
  CAST(date_diff('day', {DAY}, CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS "end", o_custkey AS gene, o_orderkey AS segment FROM orders)"""
EXONS = f"""exons AS (SELECT o_custkey % 10 AS target, CAST(date_diff('day', {DAY}, CAST(o_orderdate AS DATE)) AS BIGINT) AS start,
  CAST(date_diff('day', {DAY}, CAST(o_orderdate AS DATE)) AS BIGINT) + 3 AS "end", o_custkey % 500 AS gene FROM orders)"""
FAR = f"""{ALN}, far AS (SELECT target % 3 AS target, start * 50021 + part AS start, start * 50021 + part + length * 2003 AS "end", start * 50021 + part + length * 3 AS near_end, query, number FROM aln)"""
THIN = f'{FAR}, thin AS (SELECT target, start, near_end AS "end" FROM far)'
OBS = """obs AS (SELECT l_partkey AS pos, l_returnflag AS sample, CASE WHEN l_returnflag = 'N' THEN 'B' ELSE 'A' END AS grp, CAST(l_linenumber % 4 AS BIGINT) AS allele,
  l_linestatus AS strand, CAST(l_quantity AS BIGINT) AS quality, l_orderkey AS read, l_orderkey % 50 AS read_index FROM lineitem)"""
SITES = "sites AS (SELECT event_type AS target, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value, event_id AS id, user_id FROM events)"
MATRIX = """matrix AS (SELECT p_brand AS element, l_returnflag || l_linestatus AS sample, count(*) AS count, CAST(sum(p_size) AS BIGINT) AS length
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def runs_of(source: str, name: str, keys: str = "target", weight: str = "1") -> str:
    """CTEs that bring intervals (keys, start, end) of ``source`` to runs (keys, start, length, count) named ``name``."""
    return f"""{name}_d AS (
  SELECT {keys}, pos, sum(d) AS d FROM (SELECT {keys}, start AS pos, {weight} AS d FROM {source} WHERE start < "end" UNION ALL SELECT {keys}, "end", -({weight}) FROM {source} WHERE start < "end") GROUP BY {keys}, pos HAVING sum(d) <> 0
), {name} AS (
  SELECT {keys}, start, length, count FROM (SELECT {keys}, pos AS start, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) - pos AS length,
    CAST(sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT) AS count FROM {name}_d) WHERE length IS NOT NULL
)"""
