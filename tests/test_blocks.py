"""Two-level sweeps, joins over levels, exact tables and framed chunks, against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.functions import tails
from lociform.operators import coverage as cov
from lociform.operators import discovery as di
from lociform.operators import export as ex
from lociform.operators import filters as fl
from lociform.operators import intervals as iv
from lociform.operators import sets as st
from lociform.operators import statistics as stat
from lociform.operators import sweep
from lociform.operators import variants as va
from lociform.operators import windows as wi
from lociform.sources import archive, chunks, registry, text
from lociform.verbs import options_of


@pytest.fixture(scope="module")
def marks(spark):
    rnd = random.Random(1)
    rows = sorted({(k, rnd.randrange(400_000)) for k in "ab" for _ in range(150)} | {("a", 65_535), ("a", 65_536)})
    rows = [(k, p, rnd.randrange(9)) for k, p in rows]
    return rows, spark.createDataFrame(rows, "k string, pos long, v long").repartition(5)


def test_neighbours_over_blocks(marks):
    rows, df = marks
    got = sweep.largest_before(sweep.previous(sweep.swept(df, ["k"], "pos", {"s": "v"}), ["k"], ["pos"], F.col("v"), "before"), ["k"], ["pos"], "v", "most").collect()
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, (_, p, _) in enumerate(own):
            r = next(r for r in got if (r["k"], r["pos"]) == (k, p))
            assert r["before"] == (own[i - 1][2] if i else None) and r["most"] == max((x[2] for x in own[:i]), default=None)
            assert r["s"] == sum(x[2] for x in own[: i + 1]) and r["next_pos"] == (own[i + 1][1] if i + 1 < len(own) else None)


def test_windows_over_blocks(marks):
    rows, df = marks
    near = {(r["k"], r["pos"]): r["n"] for r in wi.trailing(df, ["k"], "pos", 30_000, {"n": F.sum("v")}).collect()}
    last = {(r["k"], r["pos"]): r["n"] for r in wi.last_sites(df, ["k"], ["pos"], 4, {"n": F.sum("v")}).collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, (_, p, _) in enumerate(own):
            assert near[k, p] == sum(v for _, q, v in own if p - 30_000 <= q <= p)
            assert last[k, p] == sum(x[2] for x in own[max(0, i - 3) : i + 1])


def test_folds_over_blocks(spark, marks):
    rows, df = marks
    wide = df.select("k", F.col("pos").alias("start"), (F.col("pos") + F.col("v") * 400).alias("end"), F.col("v").cast("double").alias("v"))
    for name, got in (("anchor", wi.anchored(wide, ["k"], 900, "last")), ("value", wi.by_difference(wide, ["k"], "v", 2.0))):
        runs = []
        for k, p, v in rows:
            e = p + v * 400
            hit = runs and runs[-1][0] == k and (p - runs[-1][4] <= 900 if name == "anchor" else abs(v - runs[-1][4]) <= 2)
            if hit:
                runs[-1][2:4] = max(runs[-1][2], e), runs[-1][3] + 1
                if name == "anchor":
                    runs[-1][4] = e
            else:
                runs.append([k, p, e, 1, e if name == "anchor" else v])
        assert sorted((r["k"], r["start"], r["end"], r["n"]) for r in got.collect()) == [tuple(r[:4]) for r in runs]


def test_overlaps_of_long_and_short(spark):
    rnd = random.Random(2)
    rows = [(i, "c", s := rnd.randrange(10**6), s + rnd.choice([0, 1, 30, 500, 40_000, 10**8])) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, k string, start long, end long")
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in iv.overlap_join(df, df, ["k"], 16).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])


def test_mean_depth_equals_counting(spark):
    rnd = random.Random(3)
    reads = [("c", s := rnd.randrange(70_000), s + rnd.randrange(1, 3000)) for _ in range(300)]
    areas = [("c", s := rnd.randrange(70_000), s + rnd.randrange(1, 9000), i % 5) for i in range(60)]
    steps = cov.coverage(spark.createDataFrame(reads, "k string, start long, end long"), ["k"], "start", "end")
    got = sorted((r["start"], r["end"], r["x"], round(r["mean_depth"], 9)) for r in iv.mean_depth(steps, spark.createDataFrame(areas + areas[:1], "k string, start long, end long, x long"), ["k"]).collect())
    assert got == sorted((s, e, x, round(sum(max(0, min(e, b) - max(s, a)) for _, a, b in reads) / (e - s), 9)) for _, s, e, x in areas + areas[:1])


def tables_like(t):
    r, c = [sum(x) for x in t], [sum(x) for x in zip(*t, strict=True)]

    def fill(i, left):
        if i == len(r) - 1:
            yield [left]
            return
        for row in itertools.product(*(range(x + 1) for x in left)):
            if sum(row) == r[i]:
                for more in fill(i + 1, [a - b for a, b in zip(left, row, strict=True)]):
                    yield [list(row), *more]

    log = lambda m: sum(map(lambda x: math.lgamma(x + 1), [*r, *c])) - math.lgamma(sum(r) + 1) - sum(math.lgamma(x + 1) for row in m for x in row)
    return min(1.0, sum(math.exp(log(m)) for m in fill(0, c) if log(m) <= log(t) + 1e-7))


def test_exact_tables():
    rnd = random.Random(4)
    for _ in range(60):
        t = [[rnd.randrange(6) for _ in range(rnd_c)] for rnd_c in [rnd.choice([2, 3])] for _ in range(rnd.choice([2, 3]))]
        if all(map(sum, t)) and all(map(sum, zip(*t, strict=True))):
            p, method = tails.fisher_table(t)
            assert method == "exact" and p == pytest.approx(tables_like(t), abs=1e-9)
    p, method = tails.fisher_table([[100, 200, 300], [150, 250, 200]])
    assert method == "exact" and 1e-8 < p < 4e-8
    assert tails.fisher_table([[1000, 2000, 3000], [1500, 2500, 2000]])[0] < 1e-70
    assert tails.fisher_table([[90, 80, 70, 60], [50, 60, 70, 80], [70, 70, 70, 70]], most=1000)[1] == "drawn"
    assert tails.fisher_table([[5, 0], [3, 0]]) == (1.0, "exact")


def test_samples_of_large_keys(spark):
    df = spark.createDataFrame([(2 * 10**15 + i,) for i in range(400)] + [(-5,), (None,)], "k long")
    got = {r["k"] for r in fl.sampled(df, F.col("k"), 0.25, 13).collect()}
    assert got == {k for k in [*(2 * 10**15 + i for i in range(400)), -5] if (k % 10007 * 7919 + 13) % 10007 < 2501}


def test_dense_indices(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "n string")
    assert sorted((r["n"], r["i"]) for r in st.indexed(df, "n", "i").collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("code", sorted(chunks.CODECS))
def test_chunks_from_anywhere(code):
    bodies = [bytes([i]) * (i * 7) + b"\xff" * (i % 9) for i in range(1, 12)]
    data = chunks.framed(bodies, code)
    found = list(chunks.chunks(data))
    assert [b for _, b in found] == bodies
    for cut in range(0, len(data), 3):
        ends = [list(chunks.chunks(data, 0, cut)), list(chunks.chunks(data, cut))]
        if code == chunks.GZIP:
            assert [b for part in ends for _, b in part] == bodies, cut
    hurt = bytearray(chunks.framed(bodies, chunks.GZIP))
    second = list(chunks.chunks(bytes(hurt)))[1][0]
    hurt[second + 14] ^= 0x55
    assert bodies[2] in [b for _, b in chunks.chunks(bytes(hurt))]
    assert list(chunks.chunks(b"")) == [] and list(chunks.chunks(b"\xff" * 40)) == []


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(chunks.framed([b"one", b"two"], chunks.GZIP))
    assert sorted(bytes(r["body"]) for r in chunks.read_chunks(spark, str(tmp_path / "a.bin")).collect()) == [b"one", b"two"]


def test_fastq_over_splits(spark, tmp_path):
    rnd = random.Random(5)
    want = [(f"r{i}", "ACGT" * rnd.randint(1, 9), None) for i in range(300)]
    want = [(h, s, "".join(rnd.choice("@I#") for _ in s)) for h, s, _ in want]
    (tmp_path / "a.fq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in want))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        df = text.read_fastq(spark, str(tmp_path / "a.fq"))
        assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_registry_and_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nAC\n")
    assert registry.read(spark, str(tmp_path / "x.fa"), steps=[lambda d: d.where("seq = 'AC'")]).count() == 1
    with pytest.raises(ValueError):
        registry.read(spark, str(tmp_path / "x.unknown"))
    with pytest.raises(ValueError):
        di.discover(spark.range(1), "unknown")
    assert options_of("a:x=1:y=2,b") == {"a": {"x": "1", "y": "2"}, "b": {}}


def test_sam_strings_of_clips_and_neighbours():
    for cigar, md, seq in (("3S4M1D2M2I3M2S", "2A1^G5", "ACGTACGTACGTACGT"), ("5M", "0A0C3", "ACGTA"), ("2M3N2M1I2M", "6", "ACGTACG")):
        segments = va.parse_alignment(11, cigar, md, seq)
        own = [{"position": s["position"], "target_aligned_length": s["target_length"], "left_clip": s["left_clip"], "right_clip": s["right_clip"], "variations": [{"from": v[0], "to": v[1], "position": v[2], "read_index": v[3]} for v in s["variations"]]} for s in segments]
        assert ex.strings_of(own) == (cigar, md)


def test_statistics_by_name(spark):
    rows = [(e, f"{g}{i}", g, c := (ord(e) * 7 + i * 3 + (g == "A") * 5) % 20 + 1, float(c)) for e in "xy" for g in "AB" for i in range(3)]
    v = spark.createDataFrame(rows, "element string, sample string, grp string, count long, value double")
    got = stat.evaluated(v, ["fold-change", "t-test", "fisher"], "A", "B")
    assert {"fold-change.fold", "t-test.t_pooled", "fisher.p"} <= set(got.columns) and got.count() == 2


def test_archive_and_callbacks(spark, tmp_path):
    a = spark.createDataFrame([("c", 0, 5, 2), ("c", 5, 5, 0), ("d", 1, 2, 4)], "target string, start long, length long, count long")
    archive.write_counts({"one": a, "two": a.where("target = 'c'")}, str(tmp_path / "x"))
    assert [r[0] for r in archive.members(spark, str(tmp_path / "x")).collect()] == ["one", "two"]
    assert [r[0] for r in archive.shared_targets(spark, str(tmp_path / "x"), ["one", "two"]).collect()] == ["c"]
    assert archive.read_counts(spark, str(tmp_path / "x"), "one").count() == 3
    got = wi.per_target(a, "target", lambda s, b: (s or 0) + len(b), lambda k, s: [(k, s)], "target string, n bigint").collect()
    assert sorted(map(tuple, got)) == [("c", 2), ("d", 1)]


def test_counts_without_pairs(spark):
    """Long, short, equal, empty and null areas; as joined pairs would count them, but many pairs cost nothing."""
    rnd = random.Random(8)
    row = lambda: (rnd.choice("ab"), s := rnd.randrange(-3000, 3000), s + rnd.choice([0, 1, 3, 16, 30, 64, 700, 5000]))
    reads, areas = [row() for _ in range(400)], [(*row(), i) for i in range(120)]
    areas += [(*areas[0][:3], 120), ("c", 1, 9, 121), ("a", None, 9, 122)]
    r, a = spark.createDataFrame(reads, "k string, start long, end long"), spark.createDataFrame(areas, "k string, start long, end long, x long")
    inside = {x["x"]: x["n"] for x in iv.contained_counts(r, a, ["k"]).collect()}
    over = {x["x"]: x["n"] for x in iv.overlap_counts(r, a, ["k"]).collect()}
    full = [(k, s, e) for k, s, e in reads if s < e]
    for k, s, e, x in areas:
        assert inside[x] == (0 if s is None or s >= e else sum(q == k and b >= s and z <= e for q, b, z in full))
        if s is None or s < e:
            assert over[x] == (0 if s is None else sum(q == k and b < e and z > s for q, b, z in full))
    most = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("start"), (F.col("id") % 7 + 2).alias("end"), "id")
    assert {x["n"] for x in iv.contained_counts(most, most, ["k"]).select("n").distinct().collect()} <= {28571, 28572}


def test_trailing_sums(spark):
    """Equal positions, nulls and values that are no numbers stay in their own windows; a dense axis costs its rows."""
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), rnd.randrange(-500, 500), rnd.choice([None, 1.5, 2.25, -7.0])) for _ in range(300)]
    rows += [("a", None, 2.0), ("a", None, 3.0), ("b", -400, math.inf), ("b", 100, -math.inf)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, pos long, v double, id long")
    for d in (0, 1, 90, 2000):
        got = {r["id"]: r for r in wi.trailing_sums(df, ["k"], "pos", d, {"n": F.lit(1), "s": F.col("v")}).collect()}
        assert len(got) == len(rows)
        for i, (k, p, _) in enumerate(rows):
            near = [v for q, at, v in rows if q == k and (at is None if p is None else at is not None and p - d <= at <= p)]
            known = [v for v in near if v is not None]
            want = math.nan if {math.inf, -math.inf} <= set(known) else sum(known) if known else None
            assert got[i]["n"] == len(near) and (got[i]["s"] == want or want is not None and math.isnan(want) and math.isnan(got[i]["s"]))
    dense = wi.trailing_sums(spark.range(300_000).withColumn("k", F.lit(0)), ["k"], "id", 100_000, {"n": F.lit(1)})
    assert dense.agg(F.sum("n")).first()[0] == sum(min(i, 100_000) + 1 for i in range(300_000))


def test_large_tables_are_exact():
    """No draw at any size: p of large 2 x 3 tables nears that of chi-square, and small ones are as by all fillings."""
    rnd = random.Random(10)
    for _ in range(40):
        t = [[rnd.randrange(7) for _ in range(3)] for _ in range(2)]
        if all(map(sum, t)) and all(map(sum, zip(*t, strict=True))):
            assert tails.fisher_table(t) == (pytest.approx(tables_like(t), abs=1e-9), "exact")
    row, every = [36_400, 71_700, 35_900], [900_000, 1_800_000, 900_000]
    expected = [sum(row) * x / sum(every) for x in every]
    chi = sum((a - b) ** 2 / b for a, b in zip(row, expected, strict=True)) / (1 - sum(row) / sum(every))
    p, method = tails.fisher_table([row, [a - b for a, b in zip(every, row, strict=True)]])
    assert method == "exact" and p == pytest.approx(math.exp(-chi / 2), abs=5e-4)


def test_repeat_lengths_of_short_and_null_texts(spark, tmp_path):
    import duckdb

    from lociform.plans.catalog import QUERIES, SQL

    texts = ["", "a", "g", "aa", "aca", "acac", "cacacat", "a" * 7, "ac" * 50_000 + "g", "ac" * 50_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["repeat_lengths"](spark, str(tmp_path)).select("doc_id", "repeats", "gaps").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(f"SELECT doc_id, repeats, gaps FROM ({SQL['repeat_lengths']})").fetchall())
    units = df.select(*(sq.repeat_length(F.lit("CACACAT"), F.lit(u)) for u in ("CA", "C", "CAC", "T", "CACACAT", "CACACATT", "")))
    assert tuple(units.first()) == (3, 1, 1, 0, 1, 0, 0)


def test_alignments_by_templates(spark):
    """Each record as ``parse_alignment`` reads it, and strings that many records share parsed once."""
    kinds = [("32M", "9A22"), ("10M2I20M", None), ("12M3D20M", "12^ACG20"), ("4S20M100N5M3S", "25"), ("5X", None), ("2H3M1P2=", "0C4"), ("40M", "32")]
    rows = [(f"q{i}", [0, 16, 128, 4][i % 4], "c", i, i % 50, *kinds[i % 7], "ACGTTGCA" * (i % 5), "*" if i % 3 else "2") for i in range(140)]
    sam = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, cigar string, md string, seq string, nh string")
    sam = sam.withColumn("tags", F.map_from_arrays(F.array(F.lit("MD"), F.lit("NH")), F.array("md", F.when(F.col("nh") != "*", F.col("nh")))))
    va._template.cache_clear()
    got = {(r["qname"], r["fragment_index"]): r for r in va.alignments(sam).collect()}
    want = {(r[0], i): (r, s) for r in rows if not r[1] & 4 for i, s in enumerate(va.parse_alignment(r[3], r[5], r[6], r[7]))}
    assert got.keys() == want.keys()
    for key, (r, s) in want.items():
        g = got[key]
        assert (g["target"], g["position"], g["reverse"], g["pair_flags"], g["mapping_quality"], g["ambiguity"]) == ("c", s["position"], bool(r[1] & 16), r[1], r[4], 2 if r[8] == "2" else 1)
        assert (g["target_aligned_length"], g["query_aligned_length"], g["left_clip"], g["right_clip"]) == (s["target_length"], s["query_length"], s["left_clip"], s["right_clip"])
        assert [tuple(v) for v in g["variations"]] == s["variations"] and g["spliced"] == ("N" in r[5])
    assert va._template("32M", "32") is va._template("32M", "32")


def test_sorted_ranges_hold_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "RANGE", 500)
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.lit("x").alias("v"))
    st.write_sorted(df, ["k"], str(tmp_path / "s"))
    files = spark.read.parquet(str(tmp_path / "s")).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(files) > 5 and max(f["n"] for f in files) < 1_500 and sum(f["n"] for f in files) == 5_000
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:], strict=False))


def test_word_counts(spark):
    """No word runs from one text into the next; any alphabet, and few rows for many places."""
    from collections import Counter

    from lociform.operators import reads as rd

    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", "ACG", None, "A" * 5_000]
    odd = [t and t + "".join(chr(rnd.randrange(200, 70_000) % 50_000 + 200) for _ in range(30)) for t in texts]
    for own in (texts, odd):
        for size in (1, 4, 12):
            got = rd._word_counts(spark.createDataFrame([(t,) for t in own], "bases string").coalesce(1), size).collect()
            n = Counter()
            for r in got:
                n[r["word"]] += r["n"]
            assert n == Counter(t[i : i + size] for t in own if t for i in range(len(t) - size + 1))
            assert len(got) == len(n) or own is odd
