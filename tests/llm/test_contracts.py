"""Each opN query over the smallest tables: its columns, their types and what they must agree with; stages on odd input."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lociform.llm import entries, sentence_pieces

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, kinds):
    df = entries.queries()[name](spark, DIR)
    assert {c: dict(df.dtypes).get(c) for c in kinds} == kinds
    return df.collect()


def grouped(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op1(spark, texts):
    got = rows(spark, "op1_near_dedup", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(LOWER)) if x]
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(pairs, ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_op2(spark, texts):
    got = rows(spark, "op2_pii", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"})
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    secrets = 0
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        secrets += sum(s[0] == "secret" for s in spans)
    assert secrets >= 0.95 * sum(len(re.findall(r'(?i)token = "[0-9a-f]{40}"', t)) for t in texts.values())


def test_op3(spark, texts):
    got = rows(spark, "op3_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op4(spark, texts):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    for r in rows(spark, "op4_media", kinds):
        raw = texts[r["doc_id"]].encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_op5(spark):
    got = rows(spark, "op5_embed_dedup", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    own = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    vec = {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in own if r["embedding"] is not None and r["label"] is not None and None not in r["embedding"]}
    vec = {i: (k, v / np.sqrt(v @ v)) for i, (k, v) in vec.items() if np.isfinite(v).all() and v.any()}
    ids = sorted(vec)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if vec[a][0] == vec[b][0] and vec[a][1] @ vec[b][1] >= 0.93]
    want = grouped(pairs, [r["vec_id"] for r in own])
    links = {r["vec_id"]: 0 for r in own}
    for p in pairs:
        for i in p:
            links[i] += 1
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == {i: (links[i], want[i], want[i] == i) for i in links}


def test_op7(spark, texts):
    kinds = {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in rows(spark, "op7_licenses", kinds):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(LOWER))
        at = [(i, k) for p, k in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        where = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({k for _, k in at})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op8(spark, texts):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=sentence_pieces.read_model(sentence_pieces.MODEL))
    for r in rows(spark, "op8_sentence_pieces", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"}):
        ids = lib.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() and r["round_trip"]


@pytest.mark.parametrize("stage", range(len(cp.STAGES)))
def test_stages_on_odd_input(spark, stage):
    """Nulls in any column, repeated rows, clashing names and an empty table: defined rows, no crash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one text that is said", "en", "s1", 5), (1, "one text that is said", "en", "s1", 5), (None, "no id", None, None, None), (3, None, "de", "s2", None), (4, "", None, "s0", 0), (5, "mail a@b.org now " * 400, "fr", None, 9)]
    name, run = cp.STAGES[stage]
    docs = spark.createDataFrame(rows, schema)
    wide = docs.withColumns({c: F.lit("clash") for c in ("key", "node", "quality", "score", "kept", "found", "tokens", "share", "__tokens", "__epoch", "id", "ids", "label")})
    got = run(spark, wide, DIR)
    if stage < len(cp.STAGES) - 1:
        assert got.columns == wide.columns
    found = sorted((r["doc_id"] for r in got.collect()), key=str)
    want = {"quality classifier": None, "near-duplicates": [3, 4, 5], "personal data": [1, 1, 3, 4, 5], "source mixing": None, "sentence pieces": [1, 1, 3, 4, 5]}[name]
    if want is not None:
        assert [i for i in found if i is not None and (i != 1 or name != "near-duplicates")] == want
    empty = run(spark, wide.limit(0), DIR)
    assert empty.columns == got.columns and empty.count() == 0
