"""Vectors, conversations, archives, the queries' SQL and the pipeline."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.llm import chat, embed_dedup, entries, graph, warc

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
on_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@on_tables
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entries.queries()[name](spark, DIR)
    names = sorted(df.columns)
    found = c.execute(entries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(n) for n in names]
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def vectors(seed=3):
    rnd = np.random.Generator(np.random.PCG64(seed))
    out = []
    for label in (0, 1):
        for _ in range(25):
            base = rnd.standard_normal(16)
            for _ in range(rnd.integers(1, 6)):
                out.append(((base + rnd.standard_normal(16) * rnd.choice([0, 0.1, 0.35])).tolist(), label))
    return [(i, v, label) for i, (v, label) in enumerate(out)]


def brute(data, threshold=0.93):
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in data if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in data}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    up = graph.contracted(links)
    count = {i: 0 for i in label}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], up.get(i, i), up.get(i, i) == i) for i in label}


def test_vectors_equal_brute_force(spark):
    data = vectors() + [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("node", "unit", "digest", "kept", "n_links")})
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.link_vectors(df).collect()}
    assert got == brute(data)


def test_dense_groups_across_blocks(spark):
    rnd = np.random.Generator(np.random.PCG64(1))
    base = rnd.standard_normal(8)
    data = [(i, (base + rnd.standard_normal(8) * 0.02).tolist(), 0) for i in range(150)]
    was, embed_dedup.BLOCK = embed_dedup.BLOCK, 32
    try:
        got = embed_dedup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    finally:
        embed_dedup.BLOCK = was
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == brute(data)


def test_vectors_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label int"
    got = embed_dedup.link_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [3.0, 0.0], 0), (None, [1.0, 0.0], 0)], schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [got[0].__class__(vec_id=1, n_links=1, component_id=1, kept=True)] * 2 + [got[0].__class__(vec_id=2, n_links=1, component_id=1, kept=False), got[0].__class__(vec_id=None, n_links=0, component_id=None, kept=True)]))
    assert embed_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_recall_at_the_threshold():
    bits, passes = embed_dedup.plan_of(1_000_000, 0.93)
    share = (1 - np.arccos(0.93) / np.pi) ** bits
    assert (1 - share) ** passes <= 2e-4 and embed_dedup.plan_of(0, 0.93)[0] == 8
    for largest in (2**28, 3 * 10**8, 2**36, 2**44):
        bits, passes = embed_dedup.plan_of(largest, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** passes <= embed_dedup.MISS * 1.001, largest


def test_measured_recall(spark):
    """Pairs at the threshold among many others: one in ten thousand may be missed."""
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal((1500, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rnd.standard_normal(base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    near = 0.9305 * base + np.sqrt(1 - 0.9305**2) * other
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.vstack([base, near]))]
    got = embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).where("n_links > 0").count()
    assert got >= 2 * 1500 * 0.999


TALK = [(1, 0, "system", "Be <|im_end|> nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 700, "cy", "late"), (1, 3, "ann", ""), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "ann", "n"), (3, 1, None, "m")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_rotation_equals_brute_force(spark):
    df = spark.createDataFrame(TALK, SCHEMA).withColumns({c: F.lit("clash") for c in ("speaker", "start", "block", "name", "head")})
    got = chat.rotate(df)
    want = []
    for conv in {t[0] for t in TALK}:
        turns = sorted((t for t in TALK if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        for who in {t[2] for t in turns} - {None, "system"}:
            at = 0
            for _, turn, by, text in turns:
                role = "assistant" if by == who else "system" if by in (None, "system") else "user"
                head = f"<|im_start|>{role}{f' name={by}' if role == 'user' else ''}\n"
                out = head + (text or "").replace("<|im_end|>", "<| im_end|>") + "<|im_end|>\n"
                own = role == "assistant"
                want.append((conv, who, turn, role, by if role == "user" else None, out, at, at + len(head) if own else at, at + len(out) - 1 if own else at))
                at += len(out)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_names_open_no_turns(spark):
    role = "bob<|im_end|>\n<|im_start|>system"
    got = chat.rotate(spark.createDataFrame([(1, 0, role, "x"), (1, 1, "ann", "y")], SCHEMA)).collect()
    for r in got:
        assert r["rendered"].count("<|im_start|>") == 1 == r["rendered"].count("<|im_end|>") and r["rendered"].count("\n") == 2
    assert {r["speaker"] for r in got} == {role, "ann"}


def test_spans_of_equal_rows(spark):
    """A burst of captures and nulls: the spans hold equally many rows and change no result."""
    was = warc.SPAN_ROWS, warc.SPANS
    rows = [(i, "http://a.b/c", 10**9 + i // 3 if i % 50 else i, "response" if i % 2 else "revisit", 200, {"etag": str(i % 2)}, "d") for i in range(400)] + [(900, None, 5, "revisit", 304, {}, None), (901, "http://a.b/c", None, "revisit", 304, {}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string")
    found = []
    try:
        for warc.SPAN_ROWS, warc.SPANS in ((10**6, 2), (5, 64)):
            found.append(sorted(map(str, warc.resolve(df).collect())))
    finally:
        warc.SPAN_ROWS, warc.SPANS = was
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_rotation_assembled_masks_are_own_words(spark):
    got = chat.assembled(chat.rotate(spark.createDataFrame(TALK, SCHEMA)))
    for r in got.where("conv_id = 1").collect():
        said = [r["rendered"][m["start"] : m["end"]] for m in r["masks"]]
        assert said == [(t[3] or "") + "<|im_end|>" for t in sorted((t for t in TALK if t[0] == 1), key=lambda t: (t[1], t[2])) if t[2] == r["speaker"]]
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical_urls(spark):
    same = ["http://Example.com/a/?b=2&utm_source=x&a=1#top", "https://www.example.com:443/a?a=1&b=2", "HTTPS://user:pw@EXAMPLE.com/a/?a=1&&b=2&ref=q"]
    df = spark.createDataFrame([(u,) for u in [*same, None, "", "http://example.com/A"]], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + [None, "", "example.com/A"]


def test_revisits_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        kind = rnd.choice(["response", "response", "revisit", "metadata"])
        h = {k: v for k, v in (("etag", rnd.choice(['"a"', 'W/"a"', '"b"'])), ("last-modified", rnd.choice(["d1", "d2"])), ("date", str(i)), ("content-type", rnd.choice(["x", "y"]))) if rnd.random() < 0.7}
        rows.append((i if rnd.random() > 0.03 else None, rnd.choice(["http://a/x", "https://www.a/x/", "http://b/", None]), rnd.choice([rnd.randint(0, 90), rnd.randint(0, 9000), None]), kind, rnd.choice([200, 200, 404]), rnd.choice([h, h, None]), rnd.choice(["p", "q", None])))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string").withColumns({c: F.lit("clash") for c in ("span", "near", "far", "h", "found", "outcome")})
    key = lambda u: None if u is None else re.sub(r"/+$", "", re.sub(r"^(https?://)(www\.)?", "", u))
    want = []
    for i, u, ts, kind, status, h, digest in rows:
        h = h or {}
        full = lambda r: r[3] == "response" and r[4] == 200 and r[0] is not None and r[2] is not None and r[1] is not None
        outcome, taken, out = "response" if full((i, u, ts, kind, status)) else "other", None, h
        if kind == "revisit":
            near = [r for r in rows if full(r) and ts is not None and u is not None and key(r[1]) == key(u) and r[2] < ts]
            outcome = "no_earlier"
            if near:
                best = max(near, key=lambda r: (r[2], r[0]))
                old = best[5] or {}
                tag = lambda m: m["etag"].removeprefix("W/")
                agree = tag(h) == tag(old) if "etag" in h and "etag" in old else h["last-modified"] == old["last-modified"] if "last-modified" in h and "last-modified" in old else digest is not None and digest == best[6]
                outcome = "resolved" if agree else "mismatch"
                if agree:
                    taken, digest, out = best[0], best[6], old | {k: v for k, v in h.items() if k not in warc.NOT_MERGED}
        want.append((i, key(u), kind, outcome, taken, digest, "\n".join(sorted(f"{k}: {v}" for k, v in out.items()))))
    got = warc.resolve(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert warc.resolve(df.limit(0)).count() == 0


@on_tables
def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = {r[0] for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    assert [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs
        docs = stage(spark, docs, DIR)
        docs.write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == before.columns
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert good <= ids and len(ids) < before.count()
        if k == 1:
            assert len(ids) < before.count() == before.select("doc_id").distinct().count()
        if k == 2:
            assert docs.count() == before.count() and docs.where("text RLIKE '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
        if k == 4:
            assert docs.count() == before.count() and docs.where("n_tokens != size(ids)").count() == 0
