"""Text formats: golden strings and round trips."""

import pytest
from pyspark.sql import functions as F

from lociform.operators import variants as va
from lociform.sources import text, tracks

VCF = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc\t5\t.\tA\tG\t9.5\tPASS\tDP=3;DB\tGT:GQ\t0/1:7\t0/0:.\nc\t6\tx\tA\tC\t.\t.\t.\tGT\t0|0\t.\n"
SAM = "@HD\tVN:1.0\nr1\t0\tc\t1\t30\t3M5N2M\t*\t0\t0\tACGTA\tIIIII\tNH:i:2\tMD:Z:1T3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tTT\tII\n"


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one x\nACG\nT\r\n>two\n\n>three\nGG")
    assert [tuple(r) for r in text.read_fasta(spark, p).orderBy("header").collect()] == [("one x", "ACGT"), ("three", "GG"), ("two", "")]


def test_fastq_round_trip(spark, tmp_path):
    body = "@a\nACGT\n+\n@@II\n@b\nTT\n+b\n!!\n\n"
    got = text.read_fastq(spark, put(tmp_path, "a.fq", body))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "ACGT", "@@II"), ("b", "TT", "!!")]
    assert sorted(r[0] for r in text.fasta_lines(got, "header", "seq", "quality").collect()) == ["@a\nACGT\n+\n@@II", "@b\nTT\n+\n!!"]
    assert min(r[0] for r in text.fasta_lines(got, "header", "seq").collect()) == ">a\nACGT"


def test_vcf(spark, tmp_path):
    got = text.read_vcf(spark, put(tmp_path, "a.vcf", VCF)).orderBy("pos").collect()
    assert got[0]["info"] == {"DP": "3", "DB": "true"} and got[0]["samples"]["s1"] == {"GT": "0/1", "GQ": "7"} and got[0]["samples"]["s2"]["GQ"] is None
    assert got[1]["qual"] is None and got[1]["info"] == {} and got[1]["samples"]["s2"] == {"GT": None}
    df = text.read_vcf(spark, put(tmp_path, "a.vcf", VCF))
    assert text.vcf_lines(df, ["GT", "GQ"], ["s1", "s2"]).collect()[0][0] == "c\t5\t.\tA\tG\t9.5\tPASS\tDB;DP=3\tGT:GQ\t0/1:7\t0/0:."
    assert text.vcf_subset(df, ["s1"]).count() == 1 and text.vcf_subset(df, ["s2"]).count() == 0
    assert tuple(text.vcf_to_tab(df, ["DP"], {"s1": ["GT"]}).orderBy("pos").first()) == ("c", 5, "3", "0/1")
    assert text.vcf_header({"DP": ("Integer", "Depth")}, {}, [])[1].startswith("##INFO=<ID=DP")


def test_vcf_without_info(spark, tmp_path):
    p = put(tmp_path, "b.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\nc\t1\t.\tA\tT\t.\t.\n")
    assert text.read_vcf(spark, p).first()["info"] == {}


def test_sam(spark, tmp_path):
    sam = text.read_sam(spark, put(tmp_path, "a.sam", SAM))
    assert text.sam_lines(sam).where("startswith(value, 'r1')").first()[0] == "r1\t0\tc\t1\t30\t3M5N2M\t*\t0\t0\tACGTA\tIIIII\tMD:Z:1T3\tNH:i:2"
    aln = va.alignments(sam).orderBy("fragment_index").collect()
    assert [(r["position"], r["ambiguity"], r["spliced"]) for r in aln] == [(0, 2, True), (8, 2, True)]
    v = va.variation_rows(va.alignments(sam)).collect()
    assert [(r["position_on_reference"], r["var_from"], r["var_to"], r["type"]) for r in v] == [(2, "T", "C", "MUTATION")]
    e = va.splice_events(va.alignments(sam)).first()
    assert (e["first"], e["last"], e["n"]) == (3, 7, 1)
    assert [tuple(r) for r in text.unaligned(sam).collect()] == [("r2", 1, "TT", "II")]


def test_sam_tags(spark, tmp_path):
    """Named tags equal those of the map, and lines of a struct those of a map; neither is read by functions of lambdas."""
    line = "r{}\t0\tc\t1\t30\t2M\t*\t0\t0\tAC\tNH:i:7"
    tails = ["", "\tNH:i:2", "\tXR:Z:a:NH:i:3\tNH:i:4", "\tNH:i:\tXR:Z:b", "\tNH:\t:x\tNH:i:5", "\tNH:ii\tXR:A:c", "\tNH:i:6\tNH:i:6", "\tNH:i:6\tNH:Z:6", "\tNHH:i:1\tnope\t\tXR:Z:-12", "\t", "\tXR:Z:\u00e4\U0001f600\tNH:Z:-", "\tNH:i:8\tXR:Z:x y", "\tNH:Z:1-\tXR:Z:5a"]
    path = put(tmp_path, "t.sam", "@HD\tVN:1.0\n" + "\r\n".join(line.format(i) + x for i, x in enumerate(tails)) + "\nshort\t4\n")
    want = [(None, None), ("2", None), ("4", "a:NH:i:3"), ("", "b"), ("5", None), (None, "c"), ("6", None), ("6", None), (None, "-12"), (None, None), ("-", "\u00e4\U0001f600"), ("8", "x y"), ("1-", "5a"), (None, None)]
    every, named = text.read_sam(spark, path), text.read_sam(spark, path, ["NH", "XR"])
    for df in (every, named):
        assert [tuple(r) for r in df.select(F.col("tags")["NH"], F.col("tags")["XR"]).collect()] == want
        assert [(r["qname"], r["flag"], r["seq"], r["qual"]) for r in df.collect()][-2:] == [("r12", 0, "AC", "NH:i:7"), ("short", 4, None, None)]
    assert every.first()["tags"] == {}
    lines = [r[0] for r in text.sam_lines(named).collect()]
    assert lines == [r[0] for r in text.sam_lines(every.withColumn("tags", F.map_filter("tags", lambda k, v: k.isin("NH", "XR")))).collect()]
    assert [x.split("\t")[11:] for x in lines[8:11]] == [["XR:i:-12"], [], ["NH:Z:-", "XR:Z:\u00e4\U0001f600"]] and lines[12].endswith("\tNH:Z:1-\tXR:Z:5a")
    for df in (every, named, text.sam_lines(named)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    twice = put(tmp_path, "u.sam", line.format(0) + "\tNH:i:1\tNH:i:2\n")
    for names in (None, ["NH"]):
        with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
            text.read_sam(spark, twice, names).collect()


def test_tracks(spark, tmp_path):
    s = spark.createDataFrame([("c", 0, 5, 0), ("c", 5, 2, 3)], "k string, start long, length long, count long")
    tracks.write_bedgraph(s, "k", str(tmp_path / "bg"))
    assert [tuple(r) for r in tracks.read_bedgraph(spark, str(tmp_path / "bg")).collect()] == [("c", 5, 2, 3.0)]
    w = spark.createDataFrame([("c", 0, 1.5), ("c", 20, 2.0)], "k string, start long, mean double")
    tracks.write_wiggle(w, "k", str(tmp_path / "w"), 20)
    lines = [x for r in spark.read.text(str(tmp_path / "w")).collect() for x in r[0].split("\n")]
    assert lines == ["variableStep chrom=c span=20", "1 1.500", "21 2.000"]


def test_tsv_types(spark, tmp_path):
    df = spark.createDataFrame([("1", "1.5", "a"), ("-2", "NaN", "3")], "i string, d string, s string")
    assert {r[0]: r[1] for r in text.column_types(df).collect()} == {"i": "Integer", "d": "Float", "s": "String"}
    text.write_tsv(df, str(tmp_path / "t"))
    assert text.read_tsv(spark, str(tmp_path / "t")).count() == 2


def test_attributes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "s1-lane2.txt").write_text("x")
    got = text.attributes_of_files(spark, str(tmp_path / "f"), ["sample", "lane"]).first()
    assert (got["sample"], got["lane"]) == ("s1", "lane2")


def test_json(spark):
    assert text.as_text(spark.createDataFrame([(1, "a")], "i int, s string")).first()[0] == '{"i":1,"s":"a"}'
    assert F is not None


def test_fastq_is_read_without_a_shuffle_of_records(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@a\nACGT\n+\n@@II\n@b\nTT\n+b\n!!\n@c\nG\n+\n@")
    (tmp_path / "b.fq").write_text("@d\nTTT\n+\n@II\n")
    got = text.read_fastq(spark, [p, str(tmp_path / "b.fq")])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "ACGT", "@@II"), ("b", "TT", "!!"), ("c", "G", "@"), ("d", "TTT", "@II")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "lead(v" not in plan
