"""Small cases with expectations worked out by hand, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.functions import tails
from lociform.operators import coverage as cov
from lociform.operators import filters as fl
from lociform.operators import intervals as iv
from lociform.operators import pileup as pu
from lociform.operators import reads as rd
from lociform.operators import sets as st
from lociform.operators import statistics as stat
from lociform.operators import sweep
from lociform.operators import variants as va
from lociform.operators import windows as wi


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


def spans(spark, data, names="k int, start long, end long"):
    return spark.createDataFrame(data, names)


def test_coverage_runs(spark):
    got = cov.coverage(spans(spark, [(1, 2, 5), (1, 3, 7), (1, 5, 7), (2, 0, 1)]), ["k"], "start", "end")
    assert rows(got, "k", "start", "length", "count") == [(1, 0, 2, 0), (1, 2, 1, 1), (1, 3, 4, 2), (2, 0, 1, 1)]


def test_coverage_closed_and_empty(spark):
    assert rows(cov.coverage(spans(spark, [(1, 2, 2)]), ["k"], "start", "end", closed=True, leading=False), "start", "length", "count") == [(2, 1, 1)]
    assert cov.coverage(spans(spark, []), ["k"], "start", "end").count() == 0


def test_coverage_area_is_sum_of_lengths(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 2), s := rnd.randint(0, 300_000), s + rnd.randint(1, 90_000)) for _ in range(300)]
    got = cov.coverage(spans(spark, data), ["k"], "start", "end").agg(F.sum(F.col("length") * F.col("count"))).first()[0]
    assert got == sum(e - s for _, s, e in data)


def test_two_level_sums_equal_plain_window(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 1), rnd.randint(0, 50), rnd.randint(-3, 3)) for _ in range(200)]
    got = sweep.running_sum(spark.createDataFrame(data, "k int, p long, v long"), ["k"], ["p"], {"t": "v"}, width=7)
    for k, p, _, t in (tuple(r) for r in got.select("k", "p", "v", "t").collect()):
        assert t == sum(v for a, b, v in data if a == k and b <= p)


def test_step_union_unaligned(spark):
    a = spark.createDataFrame([(1, 0, 10, 3)], "k int, start long, length long, count long")
    b = spark.createDataFrame([(1, 5, 10, 1)], "k int, start long, length long, count long")
    got = cov.step_union({"x": a, "y": b}, ["k"])
    assert rows(got, "start", "length", "x", "y", "total") == [(0, 5, 3, 0, 3), (5, 5, 3, 1, 4), (10, 5, 0, 1, 1)]


def test_peaks(spark):
    s = spark.createDataFrame([(1, 0, 3, 1), (1, 3, 2, 6), (1, 5, 4, 8), (1, 9, 1, 2), (1, 12, 2, 9)], "k int, start long, length long, count long")
    assert rows(cov.peaks(s, ["k"], 5), "start", "length", "sum_transition_count", "area") == [(3, 6, 14, 44), (12, 2, 9, 18)]


def test_overlap_join_and_counts_agree(spark):
    rnd = random.Random(1)
    make = lambda n, w: [(rnd.randint(0, 1), s := rnd.randint(0, 400), s + rnd.randint(1, w)) for _ in range(n)]
    reads, areas = make(120, 60), make(40, 90) + [(0, 5, 9), (0, 5, 9)]
    want = sorted((k, s, e, sum(1 for a, b, c in reads if a == k and b < e and c > s)) for k, s, e in areas)
    assert rows(iv.overlap_counts(spans(spark, reads), spans(spark, areas), ["k"]), "k", "start", "end", "n") == want
    pairs = iv.overlap_join(spans(spark, reads), spans(spark, areas), ["k"], 16)
    assert pairs.count() == sum(n for *_, n in want)


def test_latest_start(spark):
    pts = spark.createDataFrame([(1, 4), (1, 12), (1, 30)], "k int, p long")
    got = iv.latest_start(pts, spans(spark, [(1, 5, 9), (1, 10, 20), (1, 10, 15)]), ["k"], "p")
    assert rows(got, "p", "area_start", "area_end", "inside") == [(4, None, None, False), (12, 10, 20, True), (30, 10, 20, False)]


def test_best_score_keeps_non_positive(spark):
    df = spark.createDataFrame([(1, -2.0), (1, -1.0), (2, None), (3, 4.0), (3, 4.0)], "q int, s double")
    assert rows(fl.best_score(df, "q", "s")) == [(1, -1.0), (3, 4.0), (3, 4.0)]
    assert rows(fl.best_score(df, "q", "s", 1)) == [(1, -1.0)]


def test_range_is_filter(spark):
    df = spark.createDataFrame([(t, p) for t in range(4) for p in range(0, 50, 5)], "t int, p int")
    got = rows(fl.in_range(df, "t", "p", (1, 20), (2, 10)))
    assert got == [(t, p) for t in range(4) for p in range(0, 50, 5) if (1, 20) <= (t, p) <= (2, 10)]


@pytest.mark.parametrize(
    ("seq", "adapters", "left", "right", "want"),
    [("TTAC", ["GATTACA"], 3, 3, ""), ("ACATTTT", ["ACAGG"], 3, 3, "TTTT"), ("CCCCACA", ["GATTACA"], 3, 3, "CCCC"), ("TTTTCA", ["GATTACA"], 3, 3, "TTTTCA"), ("ACACCGA", ["ACA", "XGA"], 3, 2, "CC"), ("", ["ACA"], 2, 2, "")],
)
def test_trim(spark, seq, adapters, left, right, want):
    df = spark.createDataFrame([(seq,)], "s string")
    assert df.select(fl.trimmed(F.col("s"), adapters, left, right)).first()[0] == want


def counts(spark, data):
    return pu.started(spark.createDataFrame(data, "pos long, sample string, allele long, n long, forward long, reverse long"))


def test_diploid(spark):
    two = counts(spark, [(1, "s", 0, 9, 5, 4), (1, "s", 1, 6, 3, 3), (1, "s", 2, 1, 1, 0)])
    assert rows(pu.diploid(two), "allele", "n") == [(0, 9), (1, 6), (2, 0)]
    tie = counts(spark, [(1, "s", 0, 9, 5, 4), (1, "s", 1, 6, 3, 3), (1, "s", 2, 6, 3, 3)])
    assert rows(pu.diploid(tie), "allele", "n") == [(0, 9), (1, 0), (2, 0)]


def test_quarter_uses_whole_division(spark):
    c = counts(spark, [(1, "s", 0, 11, 5, 6), (1, "s", 1, 2, 1, 1), (1, "s", 2, 1, 1, 0)])
    assert rows(pu.at_least_a_quarter(c), "allele", "n") == [(0, 11), (1, 2), (2, 0)]


def test_leftover_depends_on_what_was_removed(spark):
    c = counts(spark, [(1, "s", 0, 5, 3, 2), (1, "s", 1, 4, 4, 0)])
    assert rows(pu.leftover(c, 1), "allele", "n") == [(0, 5), (1, 4)]
    assert rows(pu.leftover(pu.strand_bias(c, 2), 1), "allele", "n") == [(0, 0), (1, 0)]


def test_barcodes(spark):
    df = spark.createDataFrame([("ACGTxx",), ("ACGAxx",), ("AAAAxx",), ("AC",)], "s string")
    got = rows(fl.barcodes(df, "s", ["ACGT", "ACCA"], 1), "s", "barcode", "mismatches", "ambiguous", "rest")
    assert got == [("AAAAxx", None, None, False, "AAAAxx"), ("AC", None, None, False, "AC"), ("ACGAxx", None, 1, True, "ACGAxx"), ("ACGTxx", 0, 0, False, "xx")]


def test_set_indices_are_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "n string")
    assert rows(st.indexed(df, "n", "i")) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_fisher():
    assert tails.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(0.485714, abs=1e-6)
    assert tails.fisher_two_sided([8], [2], [1], [5])[0] == pytest.approx(0.034965, abs=1e-6)
    assert tails.fisher_table([[3, 1], [1, 3]])[0] == pytest.approx(0.485714, abs=1e-6)
    assert tails.fisher_table([[1, 2, 1, 0], [3, 3, 6, 1], [10, 10, 14, 9], [6, 7, 12, 11]], most=5_000)[0] == pytest.approx(0.7827, abs=0.02)


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert tails.gamma_q(1.0, 2.5) == pytest.approx(math.exp(-2.5))
    assert tails.gamma_q(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.poisson_cdf(3, 2.0) == pytest.approx(0.857123, abs=1e-6)


def test_qfast():
    assert tails.qfast([0.01, 0.01], compat=True) == pytest.approx(1e-4)
    four = [0.05, 0.05, 0.1, 0.1]
    x = -math.log(2.5e-5)
    assert tails.qfast(four, compat=True) == pytest.approx(0.0016935, abs=1e-6)
    assert tails.qfast(four) == pytest.approx(2.5e-5 * sum(x**i / math.factorial(i) for i in range(4)))


def test_bh_is_monotone_and_truncation_changes_nothing(spark):
    rnd = random.Random(2)
    data = [(i, rnd.random() ** 3 if i % 10 else math.nan) for i in range(500)]
    q = {r["i"]: r["q"] for r in stat.benjamini_hochberg(spark.createDataFrame(data, "i long, p double"), "p", "i").collect()}
    ordered = sorted((p, i) for i, p in data if not math.isnan(p))
    assert all(q[a] <= q[b] + 1e-12 for (_, a), (_, b) in zip(ordered, ordered[1:], strict=False))
    n, least = len(data), 1.0
    for r in range(len(ordered), 0, -1):
        p, i = ordered[r - 1]
        least = min(least, p * n / r)
        assert q[i] == pytest.approx(least)
    near = [x for x in data if x[1] < 0.1]
    cut = {r["i"]: r["q"] for r in stat.benjamini_hochberg(spark.createDataFrame(near, "i long, p double"), "p", "i", n - len(near)).collect()}
    assert all(cut[i] == pytest.approx(q[i]) for i, p in near if q[i] < 0.1)


def test_upper_quartile_counts_absent_as_zero(spark):
    c = spark.createDataFrame([("a", "s", 4), ("b", "s", 8), ("c", "t", 6), ("d", "t", 2)], "element string, sample string, count long")
    got = dict(rows(stat.upper_quartiles(c)))
    assert got == {"s": pytest.approx(8 * 20 / 14), "t": pytest.approx(6 * 20 / 14)}


def test_groups():
    assert stat.groups_of("A=s1,s2/B=s3") == {"A": ["s1", "s2"], "B": ["s3"]}
    assert stat.comparisons_of("A/B,A/C") == [("A", "B"), ("A", "C")]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN", "!+5I")], "s string, q string")
    got = df.select(sq.reverse_complement(F.col("s")), sq.color_encode(F.col("s")), sq.phred(F.col("q")), sq.to_quality(sq.phred(F.col("q"))), sq.repeat_length(F.lit("CACACG"), F.lit("CA")), sq.base_share(F.lit("GGAT"), "GC"), sq.masked_crc(F.lit("ACGT"), "1100"), fl.hamming(F.lit("ACGT"), F.lit("AGGA"))).first()
    assert got[0] == "NACGT" and got[1] == "A131." and got[2] == [0, 10, 20, 40] and got[3] == "!+5I" and got[4] == 2 and got[5] == 0.5 and got[7] == 2


def test_anchor_merge(spark):
    df = spans(spark, [(1, 0, 10), (1, 15, 20), (1, 24, 30), (1, 100, 110)])
    assert rows(wi.anchored(df, ["k"], 6), "start", "end", "n") == [(0, 20, 2), (24, 30, 1), (100, 110, 1)]
    assert rows(wi.anchored(df, ["k"], 6, "last"), "start", "end", "n") == [(0, 30, 3), (100, 110, 1)]


def test_methylation(spark):
    o = spark.createDataFrame([(1, "C", "C", False), (1, "C", "T", False), (1, "C", "T", True), (2, "G", "G", True), (2, "G", "A", True)], "pos int, ref string, base string, rev boolean")
    assert rows(wi.methylation(o, ["pos"], "ref", "base", F.col("rev")), "pos", "methylated", "unmethylated") == [(1, 1, 1), (2, 1, 1)]


def test_differing_regions(spark):
    data = [("c", p, 9, 1, 1, 9) for p in range(0, 40, 10)] + [("c", p, 5, 5, 5, 5) for p in range(5000, 5040, 10)]
    got = wi.differing_regions(spark.createDataFrame(data, "key string, pos long, ma long, ua long, mb long, ub long"), "key")
    assert rows(got, "start", "end", "sites") == [(0, 31, 4)]


def test_alignment_strings():
    seg = va.parse_alignment(11, "2S3M1I2M2D2M", "1A3^GG2", "NNACGTACTT")
    assert len(seg) == 1 and seg[0]["position"] == 10 and seg[0]["left_clip"] == "NN"
    assert seg[0]["target_length"] == 9 and seg[0]["query_length"] == 8
    assert ("A", "C", 2, 4) in seg[0]["variations"] and ("-", "T", 3, 6) in seg[0]["variations"] and ("GG", "--", 6, 8) in seg[0]["variations"]
    two = va.parse_alignment(1, "3M10N2M", None, "ACGTA")
    assert [s["position"] for s in two] == [0, 13]


def test_equivalent_indels():
    got = va.equivalent_indel("ACTCTCTGA", 4, "CT"[::-1], "")
    assert (got["start"], got["end"]) == (1, 7) or got["from"]
    same = {(x["start"], x["end"]) for x in (va.equivalent_indel("GGCACACATT", s, "CA", "") for s in (2, 4, 6))}
    assert same == {(2, 8)}
    assert va.equivalent_indel("ACGT", 9, "A", "") is None


def test_indel_alleles():
    assert va.vcf_indel("A--CAAG", ["ATTCAAG"]) == ("A", ["ATT"])
    assert va.merge_from([("CAT", "C"), ("C", "CG")]) == ("CAT", ["C", "CGAT"])


def test_realignment(spark):
    genome = "ACGTACGTTTGGCCAATCGA"
    shifted = genome[:6] + genome[8:14]
    assert va.realign_score(shifted, genome, 0, 6, 2, True) > 0
    r = spark.createDataFrame([("t", 0, 12, shifted, 0.0)], "target string, start long, end long, seq string, score double")
    i = spark.createDataFrame([("t", 6, 2, True)], "target string, at long, length long, deletion boolean")
    r = r.unionByName(spark.createDataFrame([("t", None, None, None, 1.0)], r.schema)).unionByName(r).withColumn("note", F.lit(None).cast("string"))
    for size in (5, 64):
        blocks = rd.genome_blocks(spark.createDataFrame([("t", genome)], "n string, s string"), "n", "s", size)
        got = va.realigned(r, i, blocks, size).collect()
        assert sorted((x["score"], x["note"]) for x in got) == [(1.0, None), *[(va.realign_score(shifted, genome, 0, 6, 2, True), None)] * 2], size


def test_genome_blocks_over_ends(spark):
    g = rd.genome_blocks(spark.createDataFrame([("c", "ACGTACGTAC")], "n string, s string"), "n", "s", 4)
    p = spark.createDataFrame([("c", 2), ("c", 8), ("c", 50)], "t string, p long")
    assert rows(rd.genome_get(p, g, "t", "p", 3, 4), "p", "bases") == [(2, "GTA"), (8, "AC"), (50, None)]


def test_simulated_reads(spark):
    got = rd.simulated(spark, 20, "ACGTTGCAAC", 4, 1).collect()
    for r in got:
        part = "ACGTTGCAAC"[r["pos"] : r["pos"] + 4]
        assert r["seq"] in (part, part[::-1].translate(str.maketrans("ACGT", "TGCA")))


def test_realign_score_of_each_kind():
    def slow(read, genome, start, at, length, deletion):
        score = 0
        for i, base in enumerate(read):
            here = start + i
            moved = here + length if deletion else here - length
            if here < at or (not deletion and here < at + length):
                continue
            if moved < 0 or moved >= len(genome) or here >= len(genome):
                return score - 20
            score += (genome[moved] == base) - (genome[here] == base)
        return score

    rnd = random.Random(3)
    for _ in range(3000):
        genome, read = ("".join(rnd.choices("ACé", k=rnd.randrange(lo, 14))) for lo in (1, 0))
        asked = (read, genome, rnd.randrange(9), rnd.randrange(16), rnd.randrange(1, 5), rnd.random() < 0.5)
        assert va.realign_score(*asked) == slow(*asked), asked


def test_realignment_sends_bases_once_for_each_read(spark, monkeypatch):
    """Neither a block nor a candidate indel brings a copy of the read along."""
    genome = "".join(random.Random(4).choices("ACGT", k=400))
    read = genome[:200] + genome[203:]
    r = spark.createDataFrame([("t", 0, len(read), read, 0.0)], "target string, start long, end long, seq string, score double")
    i = spark.createDataFrame([("t", at, 3, True) for at in (100, 200, 300)], "target string, at long, length long, deletion boolean")
    seen, own = [], type(r).mapInPandas
    monkeypatch.setattr(type(r), "mapInPandas", lambda df, f, schema, *a, **k: seen.append(df) or own(df, f, schema, *a, **k))
    got = va.realigned(r, i, rd.genome_blocks(spark.createDataFrame([("t", genome)], "n string, s string"), "n", "s", 16), 16).collect()
    assert [(x["shift"].at, x["gain"]) for x in got] == [(200, va.realign_score(read, genome, 0, 200, 3, True))]
    assert seen[0].count() == 1


def test_letters_as_bases(spark):
    texts = [None, "", "Zebra fox 7!", "İKÉı\U0001f600T"]
    s = F.translate(F.lower("t"), "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(sq.letters_as_bases("t").alias("a"), F.upper(F.regexp_replace(s, "[^acgt]", "")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] is None


def test_genome_blocks_of_odd_sequences(spark):
    g = rd.genome_blocks(spark.createDataFrame([("n", None), ("e", ""), ("u", "AC\n\U0001f600T")], "n string, s string"), "n", "s", 2)
    assert rows(g, "target", "block", "bases") == [("e", 0, ""), ("n", 0, None), ("u", 0, "AC"), ("u", 1, "\n\U0001f600"), ("u", 2, "T")]


def test_fisher_tails_of_many_tables(monkeypatch):
    """Equal tables are worked out once, others many at a time, and each has its own p."""
    rnd = random.Random(8)
    tables = [[rnd.randrange(m) for _ in range(4)] for m in (1, 4, 30, 200) for _ in range(60)]
    for terms in (1, 50, tails.TERMS):
        monkeypatch.setattr(tails, "TERMS", terms)
        greater, two = (f(*zip(*tables)) for f in (tails.fisher_greater, tails.fisher_two_sided))
        for (w, x, y, z), g, t in zip(tables, greater, two):
            r, c, n = w + x, w + y, w + x + y + z
            p = {k: math.comb(r, k) * math.comb(n - r, c - k) for k in range(max(0, r + c - n), min(r, c) + 1)}
            all_ = sum(p.values())
            assert g == pytest.approx(sum(v for k, v in p.items() if k >= w) / all_)
            assert t == pytest.approx(sum(v for v in p.values() if v <= p[w]) / all_)
    assert len(tails.fisher_greater([], [], [], [])) == 0
    calls, own = [], tails.log_factorial
    monkeypatch.setattr(tails, "log_factorial", lambda n: calls.append(1) or own(n))
    tails.fisher_greater(*zip(*tables * 50))
    assert len(calls) < 50


def test_points_are_not_dealt_by_block(spark, monkeypatch):
    """Few asked blocks go to the points; with many, the same bases come by a join."""
    parts = [(1, "ACG"), (2, ""), (3, "TTACCA" * 3), (4, "G"), (5, "CA")]
    whole = "".join(s for _, s in parts)
    g = rd.joined_blocks(spark.createDataFrame([("c", o, s) for o, s in parts], "t string, o long, s string"), "t", "o", "s", 4)
    assert rows(g, "block", "bases") == [(i, whole[4 * i : 4 * i + 4]) for i in range(6)]
    p = spark.createDataFrame([("c", i) for i in range(30)] + [("d", 1), (None, 2), ("c", None)], "t string, p long")
    want = sorted([("c", i, whole[i : i + 3] if i < len(whole) else "" if i // 4 == 5 else None) for i in range(30)] + [("d", 1, None)])
    for held in (rd.HELD, 0):
        monkeypatch.setattr(rd, "HELD", held)
        got = rd.genome_get(p, g, "t", "p", 3, 4)
        assert rows(got.where("t IS NOT NULL AND p IS NOT NULL"), "t", "p", "bases") == want
        assert got.count() == 33
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join LeftOuter" in plan) and (held == 0 or "rightHint=(strategy=broadcast)" in plan)


def test_peaks_over_blocks_in_one_pass(spark):
    rnd, rows_, at = random.Random(6), [], 0
    for _ in range(400):
        at, n = at + (rnd.random() < 0.1) * rnd.randrange(1, 90_000), rnd.choice([1, 40, 2000, 140_000])
        rows_.append(("k", at, n, rnd.randrange(9)))
        at += n
    want = []
    for _, start, n, count in rows_:
        if count > 2 and want and want[-1][0] + want[-1][1] == start:
            want[-1] = (want[-1][0], want[-1][1] + n, want[-1][2] + count, want[-1][3] + n * count)
        elif count > 2:
            want.append((start, n, count, n * count))
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows_, "k string, start long, length long, count long").repartition(3)
    got = cov.peaks(df.mapInPandas(passed, df.schema), ["k"], 2)
    assert rows(got, "start", "length", "sum_transition_count", "area") == want
    assert seen.value == len(rows_)
