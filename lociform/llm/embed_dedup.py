"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the signs of its products with random directions as a key,
orders all vectors of a label lexicographically by it and compares each with the next
``WINDOW`` of that order. Where more vectors than a window share the leading bits of the
key (a cell), the whole cell is compared in blocks, so that a window's bound never cuts
a dense group. A pair is counted in the first pass that compares it, which both sides'
ranks and cells tell, so no pair is ever written: a task returns a sum of links for each
vector and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import checkpointed, map_batches, table
from lociform.llm.graph import components, contracted

KEY_BITS = 30
WINDOW = 16
BLOCK = 1024
#: Vectors that a cell holds on average at most, if keys are spread evenly.
CELL = 64
#: Share of pairs at the threshold that all passes together may miss.
MISS = 1e-4


def plan_of(largest: int, threshold: float) -> tuple[int, int]:
    """(bits of a cell, passes) for a label of ``largest`` vectors.

    Two vectors at the threshold share a sign with probability 1 - angle / pi. There is no
    largest number of passes: all of them together miss a pair with a chance of ``MISS``.
    """
    bits = min(KEY_BITS, max(8, math.ceil(math.log2(max(1, largest / CELL)))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(MISS) / math.log1p(-share)))


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, digest, unit): unit is null where the vector links with nothing."""

    def rows(b: dict[str, list]) -> dict[str, list]:
        digest, unit = [], []
        for i, v, label in zip(b["vec_id"], b["v"], b["label"], strict=True):
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            ok = i is not None and label is not None and len(x) and np.isfinite(x).all() and x.any()
            if ok:
                x = x / np.abs(x).max()
                raw = (x / np.sqrt(x @ x) + 0.0).tobytes()
            digest.append(xxhash.xxh128_digest(raw) if ok else None)
            unit.append(raw if ok else None)
        return {"vec_id": b["vec_id"], "label": b["label"], "digest": digest, "unit": unit}

    return map_batches(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")), rows, "vec_id long, label string, digest binary, unit binary")


def _keyed(nodes: DataFrame, passes: int, seed: int) -> DataFrame:
    """nodes with ``keys``, one for each pass."""

    def rows(b: dict[str, list]) -> dict[str, list]:
        keys = []
        drawn: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for raw in b["unit"]:
            x = np.frombuffer(raw)
            if len(x) not in drawn:
                drawn[len(x)] = np.random.Generator(np.random.PCG64([seed, len(x)])).standard_normal((len(x), passes * KEY_BITS))
            keys.append((((x @ drawn[len(x)]) > 0).reshape(passes, KEY_BITS) @ weight).tolist())
        return {"node": b["node"], "keys": keys}

    return map_batches(nodes.select("node", "unit"), rows, "node long, keys array<long>")


def _compare(threshold: float, bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = {c: t.column(c).to_numpy() for c in ("node", "copies", "turn", "rank", "reach", "right")}
        label = t.column("label").to_numpy()
        each = lambda c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        ranks, cells = each("ranks"), each("keys") >> (KEY_BITS - bits)
        units = t.column("unit").to_pylist()
        size = np.array([len(u) for u in units])
        rows = lambda at: np.frombuffer(b"".join([units[i] for i in at])).reshape(len(at), -1)
        links, edges = np.zeros(len(size), np.int64), []
        same_block = not at["right"].any()
        for turn in np.unique(at["turn"]):
            for dim in np.unique(size[at["turn"] == turn]):
                own = np.flatnonzero((at["turn"] == turn) & (size == dim))
                left, right = own[~at["right"][own]], own if same_block else own[at["right"][own]]
                if not len(left) or not len(right):
                    continue
                cos = rows(left) @ rows(right).T
                ok = (cos >= threshold) & (at["rank"][left][:, None] < at["rank"][right]) & (at["rank"][right] <= at["reach"][left][:, None])
                i, j = np.nonzero(ok)
                i, j = left[i], right[j]
                new = label[i] == label[j]
                for s in range(turn):
                    new &= ~((cells[i, s] == cells[j, s]) | (np.abs(ranks[i, s] - ranks[j, s]) <= WINDOW))
                i, j = i[new], j[new]
                np.add.at(links, i, at["copies"][j])
                np.add.at(links, j, at["copies"][i])
                edges += zip(at["node"][i].tolist(), at["node"][j].tolist(), strict=True)
        up = contracted(edges)
        out = np.flatnonzero(links)
        node = at["node"][out].tolist()
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links[out], pa.int64()), "root": pa.array([up.get(x, x) for x in node], pa.int64())})

    return run


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors of one label are linked when their cosine in double precision is at least
    ``threshold``. Null, empty or zero vectors, vectors with a null or non-finite number,
    null labels and null ids link with nothing; vectors of different lengths neither.
    Rows that repeat an id with the same vector count once and are returned as often as
    they come. Equal directions are one node, counted with their number. Other columns are
    not read; an empty table gives no rows.
    """
    rows = checkpointed(vectors(df, id_col, vector_col, label_col))
    nodes = checkpointed(rows.where("unit IS NOT NULL").dropDuplicates(["vec_id", "label", "digest"]).groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, passes = plan_of(largest, threshold)
    keyed = checkpointed(_keyed(nodes, passes, seed))
    turns = nodes.select("node", "label").join(keyed, "node").select("node", "label", F.posexplode("keys").alias("turn", "key"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = checkpointed(turns.repartitionByRange(parts, "turn", "label", "key", "node").sortWithinPartitions("turn", "label", "key", "node"))
    row = F.monotonically_increasing_id()
    counts = dict(ordered.groupBy(F.spark_partition_id().alias("p")).count().collect())  # one number for each partition
    before = [0]
    for p in range(ordered.rdd.getNumPartitions()):
        before.append(before[-1] + counts.get(p, 0))
    offset = F.element_at(F.array(*map(F.lit, before)), F.shiftright(row, 33).cast("int") + 1)
    ranked = checkpointed(ordered.select("node", "label", "turn", "key", (offset.cast("long") + row.bitwiseAND((1 << 33) - 1)).alias("rank")))
    cell = F.shiftright("key", KEY_BITS - bits)
    ends = ranked.groupBy("turn", "label", cell.alias("cell")).agg(F.max("rank").alias("last"))
    slots = ranked.withColumn("cell", cell).join(ends, ["turn", "label", "cell"]).select("node", "label", "turn", "rank", F.greatest("last", F.col("rank") + WINDOW).alias("reach"), F.floor(F.col("rank") / BLOCK).alias("block"))
    slots = checkpointed(slots)
    spans = slots.groupBy("block").agg(F.max("reach").alias("until"))
    spans = spans.select(F.col("block").alias("i"), "until", F.explode(F.sequence("block", F.floor(F.col("until") / BLOCK))).alias("j"))
    lefts = slots.join(spans.select(F.col("i").alias("block"), "j"), "block").where(f"j = block OR reach >= j * {BLOCK}").select("node", "label", "turn", "rank", "reach", F.col("block").alias("i"), "j", F.lit(False).alias("right"))
    rights = slots.join(spans.where("i != j").select(F.col("j").alias("block"), "i", "until"), "block").where("rank <= until").select("node", "label", "turn", "rank", "reach", "i", F.col("block").alias("j"), F.lit(True).alias("right"))
    places = ranked.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "rank"))), lambda x: x["rank"]).alias("ranks"))  # one for each pass
    facts = checkpointed(nodes.select("node", "copies", "unit").join(keyed, "node").join(places, "node"))
    found = lefts.unionByName(rights).join(facts, "node").groupBy("i", "j").applyInArrow(_compare(threshold, bits), "node long, links long, root long")
    found = checkpointed(found)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select("node", "root").where("node != root").distinct())
    named = nodes.select("label", "digest", "node", "copies").join(linked, "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """Links, component and kept vector of all rows of embeddings, at a cosine of 0.93 or more."""
    return link_vectors(table(spark, sf_dir, "embeddings"))
