"""Whole texts and tables: what a cut of the input would lose, against brute force."""

import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest

from lociform.operators import reads as rd
from lociform.plans.bindings import Tables
from lociform.plans.catalog import QUERIES

COMMON = "the quick brown fox jumps over the lazy dog " * 2
TEXTS = [COMMON + "and then it sleeps", COMMON + "and then it sings in Accra", COMMON + "and then it sleeps", "short", "café " * 40 + "end"]


def bases(text):
    own = text.lower().translate(str.maketrans("bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac"))
    return "".join(c for c in own if c in "acgt").upper()


def folder(spark, at, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("texts"), documents=(list(enumerate(TEXTS)), "doc_id long, text string"))


def found(spark, name, at):
    return [r.asDict() for r in QUERIES[name](spark, at).collect()]


def test_reads_are_whole_texts(spark, texts):
    seqs = [bases(x) for x in TEXTS]
    assert {r["seq"]: r["n"] for r in found(spark, "tally_duplicates", texts)} == Counter(seqs)
    words = {w: sum(s.startswith(w, i) for s in seqs for i in range(len(s))) for w in ["A", "C", "G", "T", "CG", "CA", "AA"]}
    assert {r["word"]: r["n"] for r in found(spark, "base_composition", texts)} == words
    assert {r["doc_id"]: r["decoded"] for r in found(spark, "color_space_round_trip", texts)} == dict(enumerate(seqs))
    back = {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in enumerate(seqs)}
    assert {r["doc_id"]: r["reverse_complement"] for r in found(spark, "sequence_scalars", texts)} == back
    assert {r["target"]: r["genome"] for r in found(spark, "equivalent_indels", texts)} == {i: s for i, s in enumerate(seqs) if len(s) > 30}


def test_qualities_of_whole_texts(spark, texts):
    codes = [[ord(c) - 33 for c in x if "!" <= c <= "~"] for x in TEXTS]
    got = {r["position"]: (r["mean"], r["q50"]) for r in found(spark, "quality_percentiles", texts)}
    for p in range(max(map(len, codes))):
        own = sorted(c[p] for c in codes if p < len(c))
        assert got.pop(p) == (pytest.approx(sum(own) / len(own), abs=1e-6), own[(len(own) - 1) // 2])
    assert not got


ORDERS = [(k, (k * 7) % 1003, date(1992, 1, 1) + timedelta(days=k * 31 % 83)) for k in range(1, 161)]


def segments(orders):
    return sorted((c % 10, (d - date(1992, 1, 1)).days, (d - date(1992, 1, 1)).days + 3, c % 500) for _, c, d in orders)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("orders"), orders=(ORDERS, "o_orderkey long, o_custkey long, o_orderdate date"))


def test_peaks_of_all_targets(spark, orders):
    own = sorted((r["target"], r["start"], r["end"]) for r in Tables(spark, orders).exons.collect())
    assert {x[0] for x in own} == set(range(10))
    for name, last in (("peak_anchor_merge", False), ("peak_chain_merge", True)):
        runs = []
        for g, s, e in own:
            if runs and runs[-1][0] == g and s - runs[-1][4] <= 4:
                runs[-1][2:4] = max(runs[-1][2], e), runs[-1][3] + 1
                runs[-1][4] = e if last else runs[-1][4]
            else:
                runs.append([g, s, e, 1, e])
        assert sorted((r["target"], r["start"], r["end"], r["n"]) for r in found(spark, name, orders)) == [tuple(r[:4]) for r in runs]
    runs = []
    for (g, s, e), n in sorted(Counter(own).items()):
        if runs and runs[-1][0] == g and abs(n - runs[-1][4]) <= 1:
            runs[-1][2:4] = max(runs[-1][2], e), runs[-1][3] + 1
        else:
            runs.append([g, s, e, 1, n])
    assert sorted((r["target"], r["start"], r["end"], r["n"]) for r in found(spark, "peak_value_merge", orders)) == [tuple(r[:4]) for r in runs]


def test_exons_are_all_orders(spark, orders):
    assert sorted(tuple(r) for r in Tables(spark, orders).exons.select("target", "start", "end", "gene").collect()) == segments(ORDERS)


def test_genome_of_all_documents(spark, tmp_path):
    texts = {i: " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=5 if i < 110 else 90)) for i in range(130)}
    texts[129] = texts[128][300:]  # its seed begins deep in another text
    points = [(i, 1, i, i * 37 % 900) for i in range(60)]
    at = folder(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"), lineitem=(points, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long"))
    seqs = {i: bases(x) for i, x in texts.items()}
    places = Counter(s[i : i + 12] for s in seqs.values() for i in range(len(s) - 11))
    assert {r["doc_id"]: r["hits"] for r in found(spark, "seed_hits", at)} == {i: places[s[:12]] for i, s in seqs.items() if len(s) >= 12}
    genome = {g: "".join(seqs[i] for i in sorted(seqs) if i % 5 == g) for g in range(5)}
    assert {r["l_orderkey"]: r["bases"] for r in found(spark, "genome_lookup", at)} == {k: genome[s % 5][p % 900 : p % 900 + 6] for k, _, s, p in points}


def test_seeds_over_block_ends(spark):
    genome = rd.genome_blocks(spark.createDataFrame([("g", "ACGTACGGTTCA")], "name string, seq string"), "name", "seq", 8)
    hits = rd.seed_hits(spark.createDataFrame([("CGGTTCAA",)], "seq string"), genome, "seq", 5, 10).collect()
    assert [(r["block"], r["offset"]) for r in hits] == [(0, 6)]


def test_all_p_values_are_combined(spark, tmp_path):
    events = [(i, i % 3) for i in range(1, 2401)] + [(10007, 7), (10008, 7), (10011, 8)]
    at = folder(spark, tmp_path, events=(events, "event_id long, user_id long"))
    got = {r["user_id"]: r for r in found(spark, "combine_p", at)}
    assert set(got) == {0, 1, 2, 7, 8} and got[7]["p_qfast"] == got[7]["p_min"] == 0
    for u in (0, 1, 2, 8):
        ps = sorted(i * 7919 % 10007 / 10007 for i, user in events if user == u)
        x = -sum(Decimal(p).ln() for p in ps)
        terms = [(-x).exp()]
        for i in range(1, len(ps)):
            terms.append(terms[-1] * x / i)
        assert (got[u]["p_max"], got[u]["p_min"], got[u]["p_median"]) == pytest.approx((ps[-1], ps[0], ps[len(ps) // 2]), abs=1e-6)
        assert got[u]["p_qfast"] == pytest.approx(float(sum(terms)), abs=2e-6)
        assert got[u]["p_sum"] == pytest.approx(min(1, sum(ps)), abs=1e-6)


def test_trims_whole_texts(spark, tmp_path):
    body = "Mention of " + "many words in a row " * 5
    at = folder(spark, tmp_path, documents=([(1, "ention" + body + "the an"), (2, body + "last"), (3, "ment")], "doc_id long, text string"))
    got = {r["doc_id"]: r["trimmed"] for r in found(spark, "trim_adapter", at)}
    assert got == {1: body.lower(), 2: (body + "last").lower(), 3: "ment"}


def test_regions_cover_all_sites(spark, tmp_path):
    rows = [(p, "N", 4, "F" if p % 2 == 0 else "O", 5.0, 1) for p in (2, 40, 1700, 9000, 9001)]
    at = folder(spark, tmp_path, lineitem=(rows, "l_partkey long, l_returnflag string, l_linenumber long, l_linestatus string, l_quantity double, l_orderkey long"))
    want = Counter(i for p, *_ in rows for i in range(p // 37 + 1) if i * 37 <= p < i * 37 + 50)
    assert {r["region"]: r["sites"] for r in found(spark, "region_methylation", at)} == want
