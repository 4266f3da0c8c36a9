"""Sources and sinks by round trips through files, and scalars and programs that had no table yet."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.operators import discovery as di
from lociform.operators import filters as fl
from lociform.operators import intervals as iv
from lociform.operators import lookups as lo
from lociform.operators import sets as st
from lociform.operators import statistics as stat
from lociform.operators import variants as va
from lociform.plans.bindings import ALN, OBS, SITES, Tables, days, runs_of
from lociform.plans.interval_queries import KEYS, sample_runs
from lociform.plans.registry import query
from lociform.plans.sequence_queries import READS, reads
from lociform.scratch import fresh
from lociform.sources import archive, blocks, chunks, registry, text

# a name and a line of bases for each row of lineitem: 32 letters from a digest of the name
NAME = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR)"
BASES = "upper(translate(md5(qname), '0123456789abcdef', 'acgtacgtacgtacgt'))"


def qname():
    return F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), days("l_shipdate").cast("string"))


def bases():
    return F.translate(F.md5(qname()), "0123456789abcdef", "ACGTACGTACGTACGT")


def written(lines) -> str:
    """Lines of text in files of the shared folder."""
    path = fresh(lines.sparkSession)
    lines.write.text(path)
    return path


@query(f"WITH {READS} SELECT 'doc ' || doc_id AS header, coalesce(seq, '') AS seq FROM reads")
def fasta_round_trip(t):
    r = reads(t).select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("header"), F.coalesce("seq", F.lit("")).alias("seq"))
    return text.read_fasta(t.spark, written(text.fasta_lines(r, "header", "seq")))


@query(f"SELECT qname AS header, {BASES} AS seq, '@' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 31) AS quality FROM (SELECT *, {NAME} AS qname FROM lineitem)")
def fastq_round_trip(t):
    quality = F.concat(F.lit("@"), F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 31))
    r = t["lineitem"].select(qname().alias("header"), bases().alias("seq"), quality.alias("quality"))
    return text.read_fastq(t.spark, written(text.fasta_lines(r, "header", "seq", "quality")))


def sam(t: Tables, cigar="32M", md="32"):
    start = F.col("l_partkey") * 7 + 1
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    tags = F.struct(lit(md).alias("MD"), (F.col("l_linenumber") % 3 + 1).cast("string").alias("NH"), F.col("l_returnflag").alias("XR"))
    flag = F.when(F.col("l_linestatus") == "O", 16).otherwise(0) + F.when(F.col("l_returnflag") == "A", 4).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 0, 128).otherwise(0)
    return t["lineitem"].select(
        qname().alias("qname"), flag.alias("flag"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 10).cast("string")).alias("rname"),
        start.cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), lit(cigar).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), bases().alias("seq"), F.lit("I" * 32).alias("qual"), tags.alias("tags"),
    )


SAM = f"""sam AS (SELECT qname, CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 128 ELSE 0 END AS flag,
  'chr' || (l_suppkey % 10) AS rname, CAST(l_partkey * 7 + 1 AS INT) AS pos, CAST(l_quantity AS INT) AS mapq, {BASES} AS seq, l_linenumber AS k, l_returnflag AS xr FROM (SELECT *, {NAME} AS qname FROM lineitem))"""


@query(f"WITH {SAM} SELECT qname, flag, rname, pos, mapq, '32M' AS cigar, seq, CAST(k % 3 + 1 AS VARCHAR) AS nh, xr FROM sam")
def sam_round_trip(t):
    back = text.read_sam(t.spark, written(text.sam_lines(sam(t))), ["NH", "XR"])
    return back.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", F.col("tags")["NH"].alias("nh"), F.col("tags")["XR"].alias("xr"))


@query(f"WITH {SAM} SELECT qname AS name, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS mate, CASE WHEN (flag & 16) <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, repeat('I', 32) AS quality FROM sam WHERE xr = 'A'")
def sam_unaligned(t):
    return text.unaligned(sam(t))


KINDS = ("32M", "10M2I20M", "12M3D20M", "4S20M100N8M")
MDS = ("9A22", "30", "12^ACG20", "28")


def kinds_of(values):
    out = F.lit(values[3])
    for i in range(3):
        out = F.when(F.col("l_linenumber") % 4 == i, values[i]).otherwise(out)
    return out


@query(f"""WITH {SAM} SELECT qname, rname AS target, pos - 1 + CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 10 ELSE 13 END AS position_on_reference, CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 12 END AS read_index,
  CASE k % 4 WHEN 0 THEN 'A' WHEN 1 THEN '--' ELSE 'ACG' END AS var_from, CASE k % 4 WHEN 0 THEN substr(seq, 10, 1) WHEN 1 THEN substr(seq, 11, 2) ELSE '---' END AS var_to,
  CASE k % 4 WHEN 0 THEN 'MUTATION' WHEN 1 THEN 'READ_INSERTION' ELSE 'READ_DELETION' END AS type FROM sam WHERE k % 4 < 3 AND xr <> 'A'""")
def sam_variations(t):
    """SAM text to alignments and their variations."""
    return va.variation_rows(registry.read(t.spark, written(text.sam_lines(sam(t, kinds_of(KINDS), kinds_of(MDS)))), "sam"))


@query(f"""WITH {SAM} SELECT rname AS target, CAST(pos - 1 + 20 AS BIGINT) AS first, CAST(pos - 1 + 119 AS BIGINT) AS last, (flag & 16) <> 0 AS reverse, count(*) AS n FROM sam WHERE k % 4 = 3 AND xr <> 'A' AND mapq >= 20 GROUP BY ALL""")
def splice_counts(t):
    return va.splice_events(va.alignments(sam(t, kinds_of(KINDS), kinds_of(MDS))), 20)


@query(f"""WITH {SAM} SELECT qname, rname AS target, CAST(pos - 1 AS BIGINT) AS position, k % 4 = 3 AS spliced, CASE k % 4 WHEN 0 THEN '32M' WHEN 1 THEN '10M2I20M' WHEN 2 THEN '12M3D20M' ELSE '4S20M100N8M' END AS cigar,
  CASE k % 4 WHEN 0 THEN '9A22' WHEN 1 THEN '30' WHEN 2 THEN '12^ACG20' ELSE '28' END AS md, seq FROM sam WHERE xr <> 'A'""")
def sam_export(t):
    """Alignment rows back to SAM: CIGAR and MD are rebuilt from segments and variations."""
    from lociform.operators.export import sam_records

    own = sam(t, kinds_of(KINDS), kinds_of(MDS))
    back = sam_records(va.alignments(own)).join(own.select("qname", "seq"), "qname")
    return back.select("qname", F.col("rname").alias("target"), (F.col("pos") - 1).cast("long").alias("position"), F.col("cigar").contains("N").alias("spliced"), "cigar", "md", "seq")


def calls(t: Tables):
    p = t["part"]
    of = lambda gt, gq: F.map_from_arrays(F.array(F.lit("GT"), F.lit("GQ")), F.array(gt, gq))
    s1 = of(F.when(F.col("p_size") % 2 == 0, "0/1").otherwise("0/0"), F.col("p_size").cast("string"))
    s2 = of(F.when(F.col("p_size") % 3 == 0, "1|2").otherwise("0/0"), F.lit(None).cast("string"))
    info = F.map_from_arrays(F.array(F.lit("DP"), F.lit("DB")), F.array((F.col("p_size") * 2).cast("string"), F.lit("true")))
    return p.select(
        F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")).alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("A").alias("ref"), F.lit("C,G").alias("alt"),
        F.lit(None).cast("double").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.map_from_arrays(F.array(F.lit("s1"), F.lit("s2")), F.array(s1, s2)).alias("samples"),
    )


def stored_calls(t: Tables):
    lines = text.vcf_header({"DP": ("Integer", "Depth"), "DB": ("Flag", "Known")}, {"GT": ("String", "Genotype"), "GQ": ("Integer", "Quality")}, ["s1", "s2"])
    head = t.spark.createDataFrame([("\n".join(lines),)], "value string")
    return text.read_vcf(t.spark, written(head.unionByName(text.vcf_lines(calls(t), ["GT", "GQ"], ["s1", "s2"]))))


VCF = "vcf AS (SELECT 'chr' || (p_size % 5) AS chrom, CAST(p_partkey AS INT) AS pos, CAST(p_size * 2 AS VARCHAR) AS dp, CASE WHEN p_size % 2 = 0 THEN '0/1' ELSE '0/0' END AS gt1, CAST(p_size AS VARCHAR) AS gq1, CASE WHEN p_size % 3 = 0 THEN '1|2' ELSE '0/0' END AS gt2 FROM part)"


@query(f"WITH {VCF} SELECT chrom, pos, 'A' AS ref, 'C,G' AS alt, 'PASS' AS filter, dp, 'true' AS db, gt1, gq1, gt2, CAST(NULL AS VARCHAR) AS gq2 FROM vcf")
def vcf_round_trip(t):
    of = lambda s, n, a: F.element_at(F.element_at("samples", F.lit(s)), F.lit(n)).alias(a)
    return stored_calls(t).select("chrom", "pos", "ref", "alt", "filter", F.col("info")["DP"].alias("dp"), F.col("info")["DB"].alias("db"), of("s1", "GT", "gt1"), of("s1", "GQ", "gq1"), of("s2", "GT", "gt2"), of("s2", "GQ", "gq2"))


@query(f"WITH {VCF} SELECT chrom, pos, gt2 FROM vcf WHERE gt2 <> '0/0'")
def vcf_sample_subset(t):
    own = text.vcf_subset(stored_calls(t), ["s2"], True, ["DB"])
    return own.select("chrom", "pos", F.element_at(F.element_at("samples", F.lit("s2")), F.lit("GT")).alias("gt2"))


@query(f'WITH {VCF} SELECT chrom, pos, dp AS "DP", gt1 AS "GT[s1]", gq1 AS "GQ[s1]" FROM vcf')
def vcf_columns(t):
    """Chosen fields in the order asked for."""
    return text.vcf_to_tab(stored_calls(t), ["DP"], {"s1": ["GT", "GQ"]})


@query("SELECT CAST(c_custkey AS INT) AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def tsv_round_trip(t):
    own = t["customer"].select(F.col("c_custkey").cast("int").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    path = fresh(t.spark)
    text.write_tsv(own, path)
    kind = dict(own.dtypes)["balance"]
    return registry.read(t.spark, path, "tsv").select(F.col("key").cast("int").alias("key"), "name", F.col("balance").cast(kind).alias("balance"), "segment")


@query("SELECT * FROM (VALUES ('c_custkey', 'Integer'), ('c_acctbal', 'Float'), ('c_name', 'String')) v(\"column\", type)")
def tsv_column_types(t):
    return text.column_types(t["customer"].select(*(F.col(c).cast("string") for c in ("c_custkey", "c_acctbal", "c_name"))))


@query("""SELECT CAST(p_size AS DOUBLE) AS score, 't' || (p_partkey % 7) AS target, p_partkey AS position, 'q' || p_partkey AS query, CAST(3 AS BIGINT) AS query_position, CAST(50 AS BIGINT) AS query_length, p_size % 2 = 1 AS reverse,
  CAST(10 AS BIGINT) AS target_aligned_length, CAST(CASE WHEN p_size % 3 = 0 THEN 9 ELSE 10 END AS BIGINT) AS query_aligned_length, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS INT) AS mismatches, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS INT) AS indels FROM part""")
def maf_round_trip(t):
    odd = F.col("p_size") % 3 == 0
    s = lambda *x: F.concat_ws(" ", F.lit("s"), *x)
    key = F.col("p_partkey").cast("string")
    target = s(F.concat(F.lit("t"), (F.col("p_partkey") % 7).cast("string")), key, F.lit("10"), F.lit("+"), F.lit("99999999"), F.lit("ACGTACGTAC"))
    other = s(F.concat(F.lit("q"), key), F.lit("3"), F.when(odd, "9").otherwise("10"), F.when(F.col("p_size") % 2 == 1, "-").otherwise("+"), F.lit("50"), F.when(odd, "ACGTTCG-AC").otherwise("acgtacgtac"))
    lines = t["part"].select(F.concat_ws("\n", F.concat(F.lit("a score="), F.col("p_size").cast("string")), target, other, F.lit("")).alias("value"))
    return blocks.read_maf(t.spark, written(lines))


@query("SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS value FROM nation")
def json_rows(t):
    return text.as_text(t["nation"].select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT * FROM (VALUES ('nation.parquet', 'nation', 'parquet'), ('region.parquet', 'region', 'parquet')) v(file, name, kind)")
def file_attributes(t):
    return text.attributes_of_files(t.spark, f"{t.dir}/{{nation,region}}.parquet", ["name", "kind"])


def _framed(code):
    def run(t):
        own = t["supplier"].select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name").cast("binary").alias("body"))
        return chunks.expanded(chunks.in_chunks(own, "body", code), "chunk").select(F.col("body").cast("string").alias("body"))

    return run


for _name, _code in (("gzip", chunks.GZIP), ("bzip2", chunks.BZIP2), ("plain", chunks.PLAIN)):
    query("SELECT s_suppkey || '|' || s_name AS body FROM supplier", f"chunk_round_trip_{_name}")(_framed(_code))


ANR = ", ".join(f"aln_{s} AS (SELECT * FROM aln WHERE sample = '{s}'), {runs_of(f'aln_{s}', f'runs_{s}')}" for s in "ANR")


def counts_archive_of(t: Tables) -> str:
    path = fresh(t.spark)
    archive.write_counts({s: sample_runs(t, s) for s in "ANR"}, path)
    return path


@query(f"WITH {ALN}, {ANR}, every AS ({' UNION ALL '.join(f'''SELECT '{s}' AS member, * FROM runs_{s}''' for s in 'ANR')}) SELECT member, CAST(target AS VARCHAR) AS target, CAST(sum(length) AS BIGINT) AS sites, CAST(sum(length * count) AS BIGINT) AS bases FROM every GROUP BY ALL")
def counts_archive_totals(t):
    return archive.totals(t.spark, counts_archive_of(t))


@query(f"WITH {ALN}, {ANR} SELECT CAST(target AS VARCHAR) AS target, start, length, count FROM runs_N WHERE target = 3")
def counts_archive_member(t):
    return archive.read_counts(t.spark, counts_archive_of(t), "N", "3")


@query(f"WITH {ALN} SELECT CAST(target AS VARCHAR) AS target FROM aln WHERE sample IN ('A', 'R') GROUP BY target HAVING count(DISTINCT sample) = 2")
def shared_targets(t):
    return archive.shared_targets(t.spark, counts_archive_of(t), ["A", "R"])


@query("SELECT DISTINCT target FROM (SELECT l_suppkey % 13 AS target FROM lineitem INTERSECT SELECT o_custkey % 11 FROM orders)")
def shared_annotation_keys(t):
    """Targets that both annotation sets name."""
    a, b = t["lineitem"].select((F.col("l_suppkey") % 13).alias("target")), t["orders"].select((F.col("o_custkey") % 11).alias("target"))
    return a.distinct().join(b.distinct(), "target", "left_semi")


@query(f"WITH {READS} SELECT doc_id, seq FROM reads WHERE doc_id >= 50 AND doc_id < 150")
def read_slice(t):
    """Reads stored in order and a slice of them."""
    path = fresh(t.spark)
    archive.write_reads(reads(t).select("doc_id", "seq"), path, "doc_id", 1000)
    return archive.read_reads(t.spark, path, "doc_id", 50, 150)


@query(f"WITH {ALN} SELECT target, count(*) AS n, CAST(0 AS BIGINT) AS inversions FROM aln GROUP BY target")
def sorted_store(t):
    """Rows written in the order of target and start; inversions are rows of a file before a smaller one."""
    from pyspark.sql import Window as W

    path = fresh(t.spark)
    st.write_sorted(t.aln.select("target", "start", "query"), ["target", "start"], path, 50_000)
    stored_ = t.spark.read.parquet(path).select("target", "start", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("i"))
    # a number stands for a file's path in the rows, and a task gets a few files
    paths = sorted(r["path"] for r in stored_.select("path").distinct().collect())
    files = t.spark.createDataFrame([(x, i) for i, x in enumerate(paths)], "path string, file int")
    own = stored_.join(F.broadcast(files), "path").select("target", "start", "i", "file").repartition(len(paths) // 16 + 1, "file")
    key = F.struct("target", "start")
    before = F.lag(key).over(W.partitionBy("file").orderBy("i"))
    return own.withColumn("bad", F.coalesce(key < before, F.lit(False))).groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("inversions"))


@query("SELECT l_partkey, n, CASE WHEN n = 0 THEN 0 ELSE round(CAST(CAST(exp(-0.898699452975139 + 4.32171188401506 * ln(n) - 3.42375631012767 * ln(w)) AS FLOAT) AS DOUBLE), 3) END AS f1, round(CAST(CAST(exp(-1.57361718748031 - 3.62887641327823 * (ln(w) - ln(n)) + ln(n)) AS FLOAT) AS DOUBLE), 3) AS f2, round(exp(-0.843924877396631 + 0.887303234304011 * ln(n + 1) - 3.45874660923795 * (ln(w + 1) - ln(n + 1))), 3) AS f3, round(CAST(CAST(exp(-1.4050204825287 - 3.5820783386146 * (ln(w) - ln(n)) + ln(n)) AS FLOAT) AS DOUBLE), 3) AS f4 FROM (SELECT l_partkey, count(*) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS w FROM lineitem GROUP BY ALL)")
def bias_formulas(t):
    own = t["lineitem"].groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("double").alias("w"))
    return own.select("l_partkey", "n", *(F.round(sq.bias_formula(k, F.col("n"), F.col("w")), 3).alias(f"f{k}") for k in (1, 2, 3, 4)))


_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(kept, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"


@query(f"SELECT c_custkey, {_CRC} AS crc FROM (SELECT c_custkey, substr(c_name, 10, 1) || substr(c_name, 12, 1) || substr(c_name, 13, 2) || substr(c_name, 17, 2) AS kept FROM customer)")
def masked_crc(t):
    return t["customer"].select("c_custkey", sq.masked_crc(F.col("c_name"), "000000000" "10111" "0011").alias("crc"))


@query(f"WITH {READS} SELECT doc_id, CAST(CASE WHEN length(seq) >= 2 THEN length(regexp_extract(seq, '^(?:' || substr(seq, 1, 2) || ')*')) // 2 ELSE 0 END AS INT) AS repeats, length(seq) - length(replace(seq, 'A', '')) AS gaps FROM reads")
def repeat_lengths(t):
    s = F.col("seq")
    gapped = F.replace(s, F.lit("A"), F.lit("-"))
    return reads(t).select("doc_id", F.when(F.length(s) >= 2, sq.repeat_length(s, F.substring(s, 1, 2))).otherwise(0).alias("repeats"), sq.gap_length(gapped, F.lit("")).alias("gaps"))


@query("SELECT l_orderkey, l_linenumber, s1 <= e2 AND s2 <= e1 AS overlap, greatest(0, s2 - e1, s1 - e2) AS distance, least(s1, s2) AS merged_start, greatest(e1, e2) AS merged_end, e1 - s1 + 1 AS length FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS s1, l_partkey % 100 + l_linenumber AS e1, l_suppkey % 100 AS s2, l_suppkey % 100 + 3 AS e2 FROM lineitem)")
def segment_relations(t):
    c = [(F.col("l_partkey") % 100).alias("s1"), (F.col("l_partkey") % 100 + F.col("l_linenumber")).alias("e1"), (F.col("l_suppkey") % 100).alias("s2"), (F.col("l_suppkey") % 100 + 3).alias("e2")]
    own = t["lineitem"].select("l_orderkey", "l_linenumber", *c)
    four = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    both = sq.segment_merge(*four)
    return own.select("l_orderkey", "l_linenumber", sq.segment_overlap(*four).alias("overlap"), sq.segment_distance(*four).alias("distance"), both["start"].alias("merged_start"), both["end"].alias("merged_end"), sq.segment_length(*four[:2]).alias("length"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN b ELSE b || 'CA' END AS ref, CASE WHEN p_size % 2 = 0 THEN b || 'TT' ELSE b END AS alt FROM (SELECT p_partkey, p_size, substr('ACGT', CAST(p_size % 4 AS INT) + 1, 1) AS b FROM part)")
def indel_alleles(t):
    """Gapped alleles as REF and ALT."""
    b = F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1))
    even = F.col("p_size") % 2 == 0
    own = t["part"].select("p_partkey", F.concat(b, F.when(even, "--").otherwise("CA"), F.lit("CAAG")).alias("source"), F.array(F.concat(b, F.when(even, "TT").otherwise("--"), F.lit("CAAG"))).alias("targets"))
    return va.indel_alleles(own, "source", "targets").select("p_partkey", "ref", F.col("alts")[0].alias("alt"))


def _lf(x: str) -> str:
    return f"lgamma(CAST({x} AS DOUBLE) + 1)"


@query(f"""WITH {OBS}, r AS (SELECT read_index, sample, count(*) FILTER (allele <> 0) AS v, count(*) AS n FROM obs GROUP BY ALL), g AS (SELECT pos, grp, count(*) FILTER (allele <> 0) AS variants, count(*) FILTER (allele = 0) AS reference, CAST(sum(v) AS DOUBLE) / sum(n) AS rate FROM obs JOIN r USING (read_index, sample) GROUP BY ALL),
  x AS (SELECT pos, grp, variants, reference, CAST(floor(rate * (variants + reference) + 0.5) AS BIGINT) AS expected_variants, CAST(floor((1 - rate) * (variants + reference) + 0.5) AS BIGINT) AS expected_reference FROM g),
  k AS (SELECT *, unnest(range(variants, least(variants + expected_variants, variants + reference) + 1)) AS k FROM x)
  SELECT pos, grp, variants, reference, expected_variants, expected_reference, round(least(1.0, sum(exp({_lf('variants + expected_variants')} + {_lf('reference + expected_reference')} + {_lf('variants + reference')} + {_lf('expected_variants + expected_reference')} - {_lf('variants + expected_variants + reference + expected_reference')}
   - {_lf('k')} - {_lf('variants + expected_variants - k')} - {_lf('variants + reference - k')} - {_lf('expected_reference - variants + k')}))), 5) AS p FROM k GROUP BY ALL""")
def within_group_discovery(t):
    return di.discover(t.obs, "within-groups").withColumn("p", F.round("p", 5))


@query(f"""WITH {OBS}, x AS (SELECT pos, count(*) FILTER (grp = 'A' AND allele <> 0) AS va, count(*) FILTER (grp = 'A' AND allele = 0) AS ra, count(*) FILTER (grp = 'B' AND allele <> 0) AS vb, count(*) FILTER (grp = 'B' AND allele = 0) AS rb FROM obs GROUP BY pos),
  k AS (SELECT *, unnest(range(greatest(0, va - rb), least(va + ra, va + vb) + 1)) AS k FROM x), p AS (SELECT *, exp({_lf('va + ra')} + {_lf('vb + rb')} + {_lf('va + vb')} + {_lf('ra + rb')} - {_lf('va + ra + vb + rb')} - {_lf('k')} - {_lf('va + ra - k')} - {_lf('va + vb - k')} - {_lf('rb - va + k')}) AS w FROM k)
  SELECT pos, va AS variants_a, ra AS reference_a, vb AS variants_b, rb AS reference_b, round(log2(CAST((va + 1) * (rb + 1) AS DOUBLE) / ((ra + 1) * (vb + 1))), 6) AS log2_odds, round(least(1.0, sum(w) FILTER (w <= own * (1 + 1e-7))), 5) AS p FROM (SELECT *, max(w) FILTER (k = va) OVER (PARTITION BY pos) AS own FROM p) GROUP BY ALL""")
def compare_groups_format(t):
    return di.discover(t.obs, "compare-groups").withColumns({"log2_odds": F.round("log2_odds", 6), "p": F.round("p", 5)})


@query(f"""WITH {OBS}, gate AS (SELECT pos FROM obs WHERE allele <> 0 GROUP BY pos HAVING count(DISTINCT read_index) >= 3 AND count(*) > 10) SELECT pos, grp, count(*) FILTER (allele = 0) AS ref_count, count(*) FILTER (allele <> 0) AS var_count FROM obs WHERE pos IN (SELECT pos FROM gate) GROUP BY ALL""")
def between_groups_format(t):
    return di.discover(t.obs, "between-groups").select("pos", "grp", "ref_count", "var_count")


@query(f"WITH {OBS}, r AS (SELECT pos, sample, grp, avg(CASE WHEN allele = 0 THEN 1 ELSE 0 END) AS rp FROM obs GROUP BY ALL) SELECT pos, grp, round(avg(rp), 6) AS group_rp, count(*) AS samples FROM r GROUP BY ALL")
def allele_frequencies_format(t):
    return di.discover(t.obs, "allele-frequencies").withColumn("group_rp", F.round("group_rp", 6))


@query("SELECT k, above_test, above_null, round(1 - (above_test + 1.0) / (above_null + above_test + 1), 6) AS fdr FROM (SELECT k, count(*) FILTER (l_returnflag = 'A' AND l_quantity > k) AS above_test, count(*) FILTER (l_returnflag = 'N' AND l_quantity > k) AS above_null FROM lineitem, (SELECT unnest([10, 25, 40, 48]) AS k) GROUP BY k)")
def empirical_fdr(t):
    own = t["lineitem"].select("l_returnflag", "l_quantity", F.explode(F.array(*map(F.lit, (10, 25, 40, 48)))).alias("k"))
    n = lambda f: F.sum(((F.col("l_returnflag") == f) & (F.col("l_quantity") > F.col("k"))).cast("long"))
    got = own.groupBy("k").agg(n("A").alias("above_test"), n("N").alias("above_null"))
    return got.withColumn("fdr", F.round(stat.empirical_fdr(F.col("above_null"), F.col("above_test")), 6))


@query("SELECT * FROM (VALUES ('A', 's1'), ('A', 's2'), ('B', 's3')) v(grp, sample)")
def group_definitions(t):
    rows = [(g, s) for g, members in stat.groups_of("A=s1,s2/B=s3").items() for s in members]
    assert stat.comparisons_of("A/B, B/A") == [("A", "B"), ("B", "A")]
    return t.spark.createDataFrame(rows, "grp string, sample string")


@query("SELECT p_partkey, CAST(p_size * 2 + 1 AS DOUBLE) AS prediction FROM part")
def model_predictions(t):
    """A model's answers for batches of rows."""
    return lo.predicted(t["part"].select("p_partkey", "p_size"), lambda b: b["p_size"] * 2 + 1.0).select("p_partkey", "prediction")


@query("SELECT upper(p_name) AS value, count(*) AS n FROM part GROUP BY ALL")
def parallel_command(t):
    """A command over slices of a text."""
    return lo.piped(t["part"].select("p_name").repartition(4), "p_name", ["tr", "a-z", "A-Z"]).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, list_contains(string_split(v, '|'), 'A1') AS exact, contains(v, 'A1') AS part FROM (SELECT c_custkey, c_mktsegment || '|A' || (c_custkey % 20) AS v FROM customer) WHERE contains(v, 'A1')")
def covariate_selection(t):
    own = t["customer"].select("c_custkey", F.concat_ws("|", "c_mktsegment", F.concat(F.lit("A"), (F.col("c_custkey") % 20).cast("string"))).alias("v"))
    exact = fl.with_covariate(own, "v", "A1").select("c_custkey", F.lit(True).alias("exact"))
    some = fl.with_covariate(own, "v", "A1", False).select("c_custkey", F.lit(True).alias("part"))
    return some.join(exact, "c_custkey", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


@query("""WITH q AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ''), lambda x: x >= '!' AND x <= '~') AS l FROM documents), m AS (SELECT doc_id, list_min(list_transform(l, lambda x: ascii(x))) AS least, list_max(list_transform(l, lambda x: ascii(x))) AS most FROM q WHERE len(l) > 0)
  SELECT doc_id, least, most, CASE WHEN least < 59 THEN 'sanger' WHEN least < 64 THEN 'solexa' WHEN most > 74 THEN 'illumina' ELSE 'unknown' END AS encoding FROM m""")
def quality_ranges(t):
    codes = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: (x >= "!") & (x <= "~") & (x != "")), F.ascii)
    own = t["documents"].select("doc_id", codes.alias("c")).where(F.size("c") > 0).select("doc_id", F.array_min("c").alias("least"), F.array_max("c").alias("most"))
    return own.withColumn("encoding", sq.encoding_of(F.col("least"), F.col("most")))


@query(f"WITH {ALN}, b AS (SELECT *, length = max(length) OVER (PARTITION BY query) AS best FROM aln) SELECT 'all' AS name, count(*) AS n FROM aln UNION ALL SELECT 'best score', count(*) FILTER (best) FROM b UNION ALL SELECT 'reverse', count(*) FILTER (strand = 'O') FROM aln UNION ALL SELECT 'not best', count(*) FILTER (NOT best) FROM b")
def named_counters(t):
    """Rows by named conditions, and what a filter kept and dropped."""
    kept = fl.best_score(t.aln, "query", "length").count()
    own = fl.counted(t.aln, {"all": F.lit(True), "reverse": F.col("strand") == "O"})
    every = t.aln.count()
    return own.unionByName(t.spark.createDataFrame([("best score", kept), ("not best", every - kept)], "name string, n long"))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY source, l_linenumber % 3) - 1 AS origin, 'PLATFORM' AS platform FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS source FROM lineitem WHERE l_returnflag IN ('A', 'R'))")
def read_origins(t):
    """Read groups of concatenated data sets numbered anew, with an attribute set for all."""
    parts = [t["lineitem"].where(F.col("l_returnflag") == f).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("origin")) for f in "AR"]
    return st.with_origins(st.concatenated(parts), "source", "origin", {"platform": "PLATFORM"}).select("l_orderkey", "l_linenumber", "origin", "platform")


@query("SELECT concat_ws(chr(9), 'MATRIX', 'within', p_brand, CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)) AS value FROM part")
def pair_observations(t):
    """Observations of pairs as lines, the input of empirical p-values."""
    own = t["part"].select(F.lit("MATRIX").alias("kind"), F.lit("within").alias("pair"), "p_brand", "p_partkey", "p_size")
    return t.spark.read.text(written(stat.observation_lines(own)))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part ORDER BY place LIMIT 200")
def elements_by_statistic(t):
    """Elements by a falling statistic, then by index; the first of them."""
    return stat.top_elements(t["part"].select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 200).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"WITH {ALN} SELECT target, count(*) AS n, max(\"end\") AS last FROM aln GROUP BY target")
def per_target_callback(t):
    """A function of the user for each reference's rows."""
    import pandas as pd

    from lociform.operators.windows import per_target

    def summed(state, batch: pd.DataFrame):
        n, last = state or (0, None)
        most = int(batch["end"].max())
        return n + len(batch), most if last is None else max(last, most)

    return per_target(t.aln.select("target", "end"), "target", summed, lambda key, state: [(key, *state)], "target bigint, n bigint, last bigint")


@query(f"""WITH {ALN}, s AS (SELECT target, start, "end", gene, segment FROM (SELECT o_custkey % 10 AS target, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS "end", o_custkey AS gene, o_orderkey AS segment FROM orders)),
  o AS (SELECT s.segment, count(*) AS over_count, count(*) FILTER (r.start >= s.start AND r."end" <= s."end") AS in_count FROM s JOIN aln r ON r.target = s.target AND r.start < s."end" AND r."end" > s.start GROUP BY ALL)
  SELECT s.target, s.gene, s.segment, s."end" - s.start AS length, coalesce(in_count, 0) AS in_count, coalesce(over_count, 0) AS over_count, round(coalesce(over_count, 0) / ((s."end" - s.start) / 1000.0) / ((SELECT count(*) FROM aln) / 1e6), 4) AS rpkm, round(log2(coalesce(over_count, 0) / ((s."end" - s.start) / 1000.0) / ((SELECT count(*) FROM aln) / 1e6) + 1), 6) AS log2_rpkm FROM s LEFT JOIN o USING (segment)""")
def annotation_counts(t):
    """Counts of each segment with its length and normalised values."""
    got = iv.annotation_counts(t.aln.select("target", "start", "end"), t.ann, KEYS)
    return got.select("target", "gene", "segment", "length", "in_count", "over_count", F.round("rpkm", 4).alias("rpkm"), F.round("log2_rpkm", 6).alias("log2_rpkm"))


_TB = "UNION ALL".join(f""" SELECT o, target, start + {off} AS pos, {a}, {b} FROM runs_{s}, (SELECT unnest(range(-10, 11)) AS o) UNION ALL SELECT o, target, start + length + {off}, -({a}), -({b}) FROM runs_{s}, (SELECT unnest(range(-10, 11)) AS o)""" for s, off, a, b in (("A", "0", "count", "0"), ("N", "o", "0", "count")))


@query(f"""WITH {ALN}, {ANR}, e(o, target, pos, a, b) AS ({_TB}), p AS (SELECT o, target, pos, sum(a) AS a, sum(b) AS b FROM e GROUP BY ALL), s AS (SELECT o, target, lead(pos) OVER w AS nxt, sum(a) OVER w AS a, sum(b) OVER w AS b FROM p WINDOW w AS (PARTITION BY o, target ORDER BY pos))
  SELECT o AS "offset", CAST(sum(abs(a - b)) AS BIGINT) AS difference FROM s WHERE nxt IS NOT NULL GROUP BY o""")
def tally_offsets(t):
    """How far two step functions lie apart at each offset, of which the least is taken."""
    return stat.offset_differences(sample_runs(t, "A"), sample_runs(t, "N"), KEYS)


@query("SELECT bucket AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)), time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) - INTERVAL 30 MINUTE]) AS bucket FROM events) GROUP BY bucket")
def sliding_counts(t):
    from lociform.streaming.windows import sliding

    e = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return sliding(e, "ts", [], "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {READS} SELECT doc_id, length(seq) AS n, seq AS restored FROM reads")
def planted_indel_round_trip(t):
    """One indel is planted into each sequence and taken out again."""
    own = reads(t).select(F.col("doc_id").cast("string").alias("name"), "seq", "doc_id")
    got = lo.planted_indels(own, "name", "seq", 3, 7).join(own.select("name", "doc_id", F.length("seq").alias("n")), "name")
    head, tail = F.substring("seq", 1, F.col("at")), F.col("seq").substr(F.col("at") + 1 + F.length("inserted"), F.length("seq"))
    return got.select("doc_id", "n", F.when(F.col("at").isNull(), F.col("seq")).otherwise(F.concat(head, "deleted", tail)).alias("restored"))


@query("SELECT * FROM (VALUES ('trim', 'left', '2'), ('trim', 'right', '3'), ('sort', 'keys', 'a')) v(name, option, value)")
def dynamic_options(t):
    """Options given as text for parts of a program."""
    from lociform.verbs import options_of

    return t.spark.createDataFrame([(n, k, v) for n, own in options_of("trim:left=2:right=3,sort:keys=a").items() for k, v in own.items()], "name string, option string, value string")


@query(f"""WITH {SITES}, s AS (SELECT DISTINCT pos FROM sites), n AS (SELECT pos, CASE WHEN pos - lag(pos) OVER (ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS o FROM s), g AS (SELECT pos, sum(o) OVER (ORDER BY pos) AS g FROM n), m AS (SELECT g, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS sites FROM g GROUP BY g), c AS (SELECT g, count(*) AS bases FROM sites JOIN g USING (pos) GROUP BY g)
  SELECT start, "end", sites, bases FROM m JOIN c USING (g)""")
def segment_information(t):
    """Sites close to each other as nested segments, stored and read."""
    from lociform.operators.reads import segment_information as of

    path = fresh(t.spark)
    of(t.sites.select("pos", F.col("target").alias("sample")), 600).write.parquet(path)
    own = t.spark.read.parquet(path)
    return own.select("start", "end", F.size("sites").cast("long").alias("sites"), F.aggregate("sites", F.lit(0).cast("long"), lambda n, s: n + s["bases"]).alias("bases"))


@query(f"""WITH {SAM} SELECT qname, CAST(0 AS INT) AS fragment, CASE WHEN k % 4 = 3 THEN CAST(pos - 1 + 120 AS BIGINT) END AS forward, CAST(NULL AS BIGINT) AS backward FROM sam WHERE xr <> 'A'
  UNION ALL SELECT qname, 1, NULL, CAST(pos - 1 AS BIGINT) FROM sam WHERE xr <> 'A' AND k % 4 = 3""")
def splice_links(t):
    """Links between the segments of spliced records."""
    own = va.with_links(va.alignments(sam(t, kinds_of(KINDS), kinds_of(MDS))))
    return own.select("qname", F.col("fragment_index").alias("fragment"), F.col("splice_forward.position").alias("forward"), F.col("splice_backward.position").alias("backward"))


@query(f"""WITH {SAM}, both_ AS (SELECT l_orderkey AS q, l_linenumber % 2 = 0 AS second, min(l_partkey * 7) AS position FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
  SELECT qname, m.position AS mate FROM (SELECT CAST(l_orderkey AS VARCHAR) AS qname, l_orderkey AS q, l_linenumber % 2 = 0 AS second FROM lineitem WHERE l_returnflag <> 'A') r LEFT JOIN both_ m ON m.q = r.q AND m.second <> r.second""")
def mate_links(t):
    """The place of each record's mate (X17): records of an order are mates, the first by place counts."""
    own = sam(t).withColumn("qname", F.split("qname", "_")[0])
    placed = va.with_links(va.alignments(own).withColumn("target", F.lit("c")))
    return placed.select("qname", F.col("pair_link.position").alias("mate"))


@query(f"WITH {READS}, g AS (SELECT doc_id, seq, length(seq) AS n, length(seq) // 2 AS m FROM reads WHERE length(seq) >= 8), s AS (SELECT doc_id, len(list_filter(range(m, n - 3), lambda i: substr(seq, i + 1, 1) <> substr(seq, i + 4, 1))) AS gain FROM g) SELECT doc_id, CAST(gain AS DOUBLE) AS score, CASE WHEN gain > 0 THEN gain END AS gain FROM s")
def local_realignment(t):
    """Each sequence without three bases in its middle is realigned over the known deletion."""
    from lociform.operators import reads as rd

    g = reads(t).where("length(seq) >= 8").withColumn("target", F.col("doc_id").cast("string")).withColumn("at", F.floor(F.length("seq") / 2).cast("long"))
    cut = F.concat(F.substring("seq", 1, F.col("at").cast("int")), F.col("seq").substr((F.col("at") + 4).cast("int"), F.length("seq")))
    own = g.select("doc_id", "target", F.lit(0).cast("long").alias("start"), (F.length("seq") - 3).cast("long").alias("end"), cut.alias("seq"), F.lit(0.0).alias("score"))
    indels = g.select("target", "at", F.lit(3).cast("long").alias("length"), F.lit(True).alias("deletion"))
    blocks_ = rd.genome_blocks(g.select("target", "seq"), "target", "seq", 4096)
    return va.realigned(own, indels, blocks_, 4096).select("doc_id", "score", "gain")
