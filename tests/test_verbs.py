import pytest
from pyspark.sql import functions as F

from lociform.operators import lookups as lo
from lociform.sources.blocks import read_maf
from lociform.verbs import VERBS, run


@pytest.fixture
def stored(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    return put


def test_counts_and_tracks(spark, stored):
    reads = stored("reads", [("c", 2, 5), ("c", 4, 6), ("d", 0, 1)], "target string, start long, end long")
    steps = run(spark, "alignment-to-counts", input=reads)
    assert sorted(map(tuple, steps.where("target = 'c'").collect())) == [("c", 0, 2, 0), ("c", 2, 2, 1), ("c", 4, 1, 2), ("c", 5, 1, 1)]
    counts = stored("counts", [tuple(r) for r in steps.collect()], "target string, start long, length long, count long")
    assert run(spark, "counts-to-bedgraph", counts=counts).count() == 4
    assert [r["length"] for r in run(spark, "count-archive-to-peak-annotations", counts=counts, threshold="1").collect()] == [1]
    areas = stored("areas", [("c", 3, 5, 7), ("d", 9, 12, 8)], "target string, start long, end long, gene long")
    assert {r["gene"]: r["n"] for r in run(spark, "alignment-to-annotation-counts", input=reads, annotations=areas).collect()} == {7: 2, 8: 0}
    assert run(spark, "coverage", counts=counts, annotations=areas).count() == 1
    assert run(spark, "annotation-penalty", a=reads, b=areas).count() == 2
    assert run(spark, "annotations-to-counts", annotations=areas, flank="2").orderBy("target").first()["length"] == 6


def test_unknown_option(spark):
    with pytest.raises(ValueError, match="has no option"):
        run(spark, "sort", nothing=1)


def test_stats(spark, stored):
    rows = [(f"e{i}", s, 5 + i * (j + 1), 1000) for i in range(6) for j, s in enumerate(("s1", "s2", "s3", "s4"))]
    counts = stored("expr", rows, "element string, sample string, count long, length long")
    got = run(spark, "stats", counts=counts, groups="A=s1,s2/B=s3,s4", compare="A/B")
    assert got.count() == 6 and {"fold", "p_fisher", "p_pooled", "q"} <= set(got.columns)


def test_command_for_each_slice(spark, tmp_path):
    (tmp_path / "t.txt").write_text("ab\ncd\nef\n")
    got = run(spark, "run-parallel", input=str(tmp_path / "t.txt"), command="tr a-z A-Z", slices=2)
    assert sorted(r["value"] for r in got.collect()) == ["AB", "CD", "EF"]


def test_maf(spark, tmp_path):
    text = "# note\n\na score=27\ns chr1 10 8 + 100 ACGT-ACGT\ns r1 0 8 - 36 ACCTTAC-T\n\na score=5\ns chr2 0 2 + 9 AC\ns r2 1 2 + 36 AC\n"
    (tmp_path / "x.maf").write_text(text)
    got = sorted(map(tuple, read_maf(spark, str(tmp_path / "x.maf")).collect()))
    assert got == [(5.0, "chr2", 0, "r2", 1, 36, False, 2, 2, 0, 0), (27.0, "chr1", 10, "r1", 0, 36, True, 8, 8, 1, 2)]


def test_planted_indels_can_be_undone(spark):
    seqs = [(f"n{i}", "ACGTTGCAAC" * 3) for i in range(20)] + [("short", "AC")]
    got = lo.planted_indels(spark.createDataFrame(seqs, "name string, seq string"), "name", "seq", 3, 5).collect()
    kinds = set()
    for r in got:
        if r["at"] is None:
            assert r["name"] == "short" and r["seq"] == "AC"
            continue
        a = r["at"]
        back = r["seq"][:a] + r["deleted"] + r["seq"][a + len(r["inserted"]) :]
        assert back == "ACGTTGCAAC" * 3
        kinds.add(bool(r["deleted"]))
    assert kinds == {True, False}


def test_bisulfite_reads(spark):
    df = spark.createDataFrame([(0, "CCCCACCGT"), (4, "ACCGT")], "pos long, seq string")
    none = [r["seq"] for r in lo.bisulfite_reads(df, "seq", "pos", 0.0, 1).collect()]
    every = [r["seq"] for r in lo.bisulfite_reads(df, "seq", "pos", 1.1, 1).collect()]
    half = [r["seq"] for r in lo.bisulfite_reads(df, "seq", "pos", 0.5, 1).collect()]
    assert none == ["TTTTATTGT", "ATTGT"] and every == ["CCCCACCGT", "ACCGT"] and half[0][4:] == half[1]


def test_model_hook(spark):
    got = lo.predicted(spark.range(5), lambda b: b["id"] * 2.0)
    assert [r["prediction"] for r in got.orderBy("id").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_known_and_maps(spark):
    calls = spark.createDataFrame([("c", 1, "A", "AT"), ("c", 2, "A", "G"), (None, 3, "AC", "A")], "chrom string, pos int, ref string, alt string")
    known = lo.indel_positions(calls, ["chrom", "pos"], "ref", F.split("alt", ","))
    assert {r["pos"]: r["known"] for r in lo.with_known(calls, known, ["chrom", "pos"]).collect()} == {1: True, 2: False, 3: False}


def test_verbs_are_described():
    assert len(VERBS) >= 40
