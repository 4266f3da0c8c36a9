"""Near-duplicate documents by SetSketch registers, banding and exact verification.

Equal shingle sets become one node first. Bands of registers deal the nodes into
buckets; each node is compared with its bucket's node of the smallest id (a star, not all
pairs), and links are confirmed on full shingle sets. What a star can miss, two
linked nodes of one bucket that are in different components yet, is then looked for
exactly: nodes outside the component of their bucket's first node are compared by register
likelihood with the bucket's other components; few likely members are verified pair by
pair, many in blocks of the component, up to the first link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import checkpointed, if_small, map_batches, table
from lociform.llm.graph import components
from lociform.llm.shingles import SetSketch, overlap, set_key, shingle_set

BANDS, ROWS = 32, 5
SKETCH = SetSketch(BANDS * ROWS)
#: Estimates this far below the threshold are not verified: five standard errors of 160 registers.
MARGIN = 0.15
BLOCK = 256
#: Shingles of all sets of a block on average at most: 4 MB.
SHINGLES = 1 << 19
#: Members of a component that are compared with an outsider pair by pair; more are taken in blocks.
FEW = 4
#: Parts that the members of a pivot are dealt over.
SALTS = 32
SMALL = 500_000


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, registers) of each row of (doc_id, text)."""

    def rows(b: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in b["text"]]
        return {"doc_id": b["doc_id"], "n": [len(s) for s in sets], "key": [set_key(s) for s in sets], "registers": [SKETCH.of(s).tobytes() for s in sets]}

    return map_batches(docs, rows, "doc_id long, n long, key binary, registers binary")


def _bucket(band: int):
    return F.xxhash64(F.lit(band), F.substring("registers", 1 + band * ROWS * 2, ROWS * 2))


def _in_bands(nodes: DataFrame) -> DataFrame:
    """(node, least, band, bucket) for each band of each node."""
    return nodes.select("node", "least", F.posexplode(F.array(*(_bucket(i) for i in range(BANDS)))).alias("band", "bucket"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = overlap(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the wanted nodes (node, doc_id, key); the texts stay where they are unless the nodes are too many to broadcast.

    Of the rows with a node's id those count whose set has the node's key.
    """
    wanted = docs.join(if_small(nodes, SMALL), "doc_id").select("node", "key", "text")

    def rows(b: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in b["text"]]
        own = [i for i, s in enumerate(sets) if set_key(s) == b["key"][i]]
        return {"node": [b["node"][i] for i in own], "hashes": [sets[i].tobytes() for i in own]}

    return map_batches(wanted, rows, "node long, hashes binary").dropDuplicates(["node"])


def _cross(percent: int):
    """For one bucket's block of outsiders and block of members: what is left to compare.

    A pair of different components counts in the first band that it shares, if its
    estimate passes. Few such members of a component come as pairs (a, b), many as one
    row with the component instead.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, comp, n, band = (np.array(t.column(c).to_pylist()) for c in ("node", "comp", "n", "band"))
        side = np.array(t.column("outsider").to_pylist(), bool)
        regs = np.frombuffer(b"".join(x.as_py() for x in t.column("registers")), np.uint16).reshape(len(node), -1)
        ys = np.flatnonzero(~side)
        out: list[tuple] = []
        for x in np.flatnonzero(side):
            other = ys[comp[ys] != comp[x]]
            shared = (regs[other] == regs[x]).reshape(len(other), BANDS, ROWS).all(2).argmax(1) if len(other) else other
            other = other[shared == band[x]]
            other = _likely(x, other, n, regs, percent)
            found, count = np.unique(comp[other], return_counts=True)
            many = set(found[count > FEW].tolist())
            out += [(int(node[x]), None, c) for c in many]
            out += [(int(node[x]), int(node[y]), None) for y in other if int(comp[y]) not in many]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("a", "b", "comp"))})

    return run


def _likely(x: int, other: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``other`` that may reach the threshold with ``x``, the likeliest first."""
    other = other[np.minimum(n[other], n[x]) * 100 >= percent * np.maximum(n[other], n[x])]
    if not len(other):
        return other
    est = SKETCH.similarity(np.broadcast_to(regs[x], (len(other), regs.shape[1])), regs[other], np.full(len(other), float(n[x])), n[other].astype(float))
    good = est >= percent / 100 - MARGIN
    return other[good][np.argsort(-est[good], kind="stable")]


def _against(percent: int):
    """For one block of a component and one of outsiders: a confirmed link of each outsider, if there is one."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, n = (np.array(t.column(c).to_pylist()) for c in ("node", "n"))
        side = np.array(t.column("outsider").to_pylist(), bool)
        regs = np.frombuffer(b"".join(x.as_py() for x in t.column("registers")), np.uint16).reshape(len(node), -1)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        ys, out = np.flatnonzero(~side), []
        for x in np.flatnonzero(side):
            for y in _likely(x, ys, n, regs, percent):
                common = overlap(sets[x], sets[y])
                if 100 * common >= percent * (n[x] + n[y] - common):
                    out.append((int(node[x]), int(node[y])))
                    break
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate("ab")})

    return run


def _rest(members: DataFrame, comps: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that the stars left, from all pairs of a bucket
    that lie in different ones."""
    of = info.select("node", "n").join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", "n", F.coalesce("component_id", "node").alias("comp"))
    # a pivot may have very many members: they are dealt over parts of it
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    pivots = of.join(members.select(F.col("pivot").alias("node")).distinct(), "node").select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    placed = members.join(of.drop("n"), "node").withColumn("salt", salt).join(pivots, ["pivot", "salt"])
    blocks = F.ceil(F.col("members") / BLOCK)
    placed = checkpointed(placed.select("bucket", "band", "node", "comp", (F.col("comp") != F.col("pivot_comp")).alias("outside"), F.pmod(F.xxhash64("node"), blocks).alias("block"), blocks.alias("blocks")))
    outside = placed.where("outside")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    wide = outside.select("bucket", "band", "node", "comp", F.lit(True).alias("outsider"), F.col("block").alias("i"), every.alias("j"))
    others = placed.select("bucket", "band", "node", "comp", F.lit(False).alias("outsider"), F.col("block").alias("j")).join(outside.select("bucket", F.col("block").alias("i")).distinct(), "bucket").select(*wide.columns)
    left = wide.unionByName(others).join(info, "node").groupBy("bucket", "i", "j").applyInArrow(_cross(percent), "a long, b long, comp long")
    left = checkpointed(left.distinct())
    pairs = left.where("b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    asked = left.where("b IS NULL").select(F.col("a").alias("node"), "comp").distinct()
    # blocks are bounded in sets and in shingles
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES))
    width = asked.join(info.select("node", "n"), "node").groupBy("comp").agg(parts.alias("is"))
    size = of.join(width, "comp").groupBy("comp").agg(parts.alias("js"), F.first("is").alias("is"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    xs = asked.join(size, "comp").select("comp", "node", F.lit(True).alias("outsider"), part("is").alias("i"), all_of("js").alias("j"))
    ys = of.join(size, "comp").select("comp", "node", F.lit(False).alias("outsider"), all_of("is").alias("i"), part("js").alias("j"))
    blocks = xs.unionByName(ys.select(*xs.columns)).join(info, "node").join(sets, "node").select("comp", "i", "j", "node", "n", "outsider", "registers", "hashes")
    more = blocks.groupBy("comp", "i", "j").applyInArrow(_against(percent), "a long, b long")
    return _verified(pairs, sets, percent).unionByName(more)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked;
    component_id is the smallest id reachable. Rows without words (null or empty text) and
    rows with a null id are linked with nothing; a null id has a null component and is kept.
    Rows that share an id are one document: what any of their texts links with, all of them
    are linked with, and each row is returned with its own n_shingles. Other columns are not
    read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = checkpointed(sketches(docs, width))
    words = seen.where("n > 0 AND doc_id IS NOT NULL")
    keys = words.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = checkpointed(keys.withColumn("node", F.monotonically_increasing_id()))
    banded = _in_bands(nodes)
    # the pivot is the text of the smallest id: copies come later and resemble it more than each other
    first = F.min(F.struct("least", "node"))["node"]
    shared = banded.groupBy("bucket").agg(first.alias("pivot"), F.count("*").alias("members")).where("members > 1")
    members = checkpointed(banded.drop("least").join(shared, "bucket"))
    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    info = checkpointed(nodes.join(members.select("node").distinct(), "node").select("node", "n", "registers", "least", "key"))
    sets = checkpointed(_sets_of(docs, info.select("node", F.col("least").alias("doc_id"), "key"), width))
    info = info.select("node", "n", "registers")
    links = checkpointed(_verified(stars, sets, percent).unionByName(_same_id(words, nodes)))
    comps = components(links)
    links = checkpointed(links.unionByName(_rest(members, comps, info, sets, percent)))
    comps = components(links)
    grouped = comps.select(F.col("id").alias("node"), "component_id").unionByName(comps.select(F.col("component_id").alias("node"), "component_id").distinct())
    tagged = nodes.join(grouped, "node", "left").where("copies > 1 OR component_id IS NOT NULL").select("key", "least", F.coalesce("component_id", "node").alias("root"))
    smallest = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tagged.select("key", "root").join(if_small(smallest, SMALL), "root").select("key", "component_id")
    known = seen.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of ids that have several: those of the smallest and of any other node."""
    several = checkpointed(words.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("doc_id"))
    texts = words.join(if_small(several, SMALL), "doc_id", "left_semi").select("doc_id", "key").distinct()
    texts = texts.join(nodes.select("key", "node"), "key").select("doc_id", "node")
    firsts = texts.groupBy("doc_id").agg(F.min("node").alias("a"))
    return texts.join(firsts, "doc_id").where("node != a").select("a", F.col("node").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest id."""
    gone = checkpointed(link_documents(docs, id_col, text_col, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(if_small(gone, SMALL), docs[id_col] == F.col("__gone"), "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity of 0.8 or more, over all documents."""
    return link_documents(table(spark, sf_dir, "documents"), width=2)
