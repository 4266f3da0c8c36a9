"""Filters, best hits, set operations, pileup and genotype filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociform.operators import filters as fl
from lociform.operators import pileup as pu
from lociform.operators import sets as st
from lociform.plans.bindings import ALN, ANN, OBS, SITES, Tables
from lociform.plans.registry import query


@query(f"WITH {ALN} SELECT target, start, query, number FROM aln WHERE (target > 2 OR (target = 2 AND start >= 100)) AND (target < 5 OR (target = 5 AND start <= 900))")
def range_filter(t):
    return fl.in_range(t.aln, "target", "start", (2, 100), (5, 900)).select("target", "start", "query", "number")


@query(f"WITH {ALN} SELECT target, start, query, number FROM aln WHERE target IN (1, 4, 7)")
def reference_filter(t):
    return fl.named(t.aln, "target", "1, 4,7").select("target", "start", "query", "number")


@query(f"WITH {ALN} SELECT query, number, start, start >= 1200 AS emit FROM aln WHERE start BETWEEN 1150 AND 1500")
def window_with_flap(t):
    return fl.with_flap(t.aln, "start", 1200, 1500, 50).select("query", "number", "start", "emit")


@query(f"WITH {ALN} SELECT query, number, score FROM aln QUALIFY score = max(score) OVER (PARTITION BY query)")
def best_score_only(t):
    return fl.best_score(t.aln, "query", "score").select("query", "number", "score")


@query(f"WITH {ALN}, b AS (SELECT query, number, length FROM aln QUALIFY length = max(length) OVER (PARTITION BY query)) SELECT query, number, length FROM b QUALIFY count(*) OVER (PARTITION BY query) <= 1")
def best_score_k(t):
    return fl.best_score(t.aln, "query", "length", 1).select("query", "number", "length")


@query(f"WITH {ALN}, ok AS (SELECT query FROM aln JOIN (SELECT p_partkey AS part, p_brand AS gene FROM part) g USING (part) GROUP BY query HAVING count(DISTINCT gene) <= 3) SELECT query, number, part FROM aln WHERE query IN (SELECT query FROM ok)")
def distinct_genes_k(t):
    genes = t["part"].select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("gene"))
    return fl.few_genes(t.aln, genes, "query", "part", "gene", 3).select("query", "number", "part")


@query(f"WITH {ALN}, b AS (SELECT * FROM aln QUALIFY length = max(length) OVER (PARTITION BY query)), ok AS (SELECT query FROM b JOIN part ON p_partkey = part GROUP BY query HAVING count(DISTINCT p_brand) <= 1) SELECT query, number FROM b WHERE query IN (SELECT query FROM ok)")
def best_score_few_genes(t):
    genes = t["part"].select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("gene"))
    return fl.few_genes(fl.best_score(t.aln, "query", "length"), genes, "query", "part", "gene", 1).select("query", "number")


HITS = "hits AS (SELECT o_orderkey AS query, o_custkey % 9 AS hits, o_custkey % 40 AS match_length FROM orders WHERE o_orderkey % 3 = 0)"


def hits(t: Tables):
    return t["orders"].where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("query"), (F.col("o_custkey") % 9).alias("hits"), (F.col("o_custkey") % 40).alias("match_length"))


@query(f"WITH {ALN}, {HITS} SELECT query, number FROM aln WHERE query NOT IN (SELECT query FROM hits)")
def nonambiguous(t):
    return fl.without_listed(t.aln, hits(t), "query").select("query", "number")


@query(f"WITH {ALN}, {HITS} SELECT query, number FROM aln WHERE query IN (SELECT query FROM hits)")
def listed_reads(t):
    return fl.listed(t.aln, hits(t), "query").select("query", "number")


@query(f"WITH {ALN}, {HITS} SELECT a.query, a.number, coalesce(h.hits >= 4, FALSE) AS is_ambiguous FROM aln a LEFT JOIN hits h USING (query)")
def ambiguous_at_k(t):
    return fl.ambiguous(t.aln, hits(t), "query", 4, 10).select("query", "number", "is_ambiguous")


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey % 9 AS hits, o_orderkey % 40 AS match_length FROM orders WHERE o_orderkey % 40 <> 1)
  SELECT query, match_length, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT * FROM h QUALIFY match_length = max(match_length) OVER (PARTITION BY query)) GROUP BY ALL""")
def too_many_hits_merge(t):
    h = t["orders"].select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 9).alias("hits"), (F.col("o_orderkey") % 40).alias("match_length"))
    return fl.merge_hits(h, "query")


@query(f"WITH {ALN} SELECT query, number FROM aln WHERE number % 5 + part % 3 <= floor(length * 0.05 + 0.5)")
def percent_mismatch_filter(t):
    df = t.aln.withColumns({"mm": F.col("number") % 5, "ind": F.col("part") % 3})
    return fl.few_mismatches(df, "mm", "ind", "length").select("query", "number")


@query(f"WITH {ALN} SELECT query, number FROM aln WHERE ((query * 7 + number) * 7919 + 13) % 10007 < 2501")
def downsample(t):
    return fl.sampled(t.aln, F.col("query") * 7 + F.col("number"), 0.25, 13).select("query", "number")


@query(f"WITH {OBS} SELECT pos, sample, allele, read FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY pos ORDER BY (read * 7919 + allele) % 10007, read, allele, quality) <= 5)")
def sample_cap_per_site(t):
    order = [(F.col("read") * 7919 + F.col("allele")) % 10007, F.col("read"), F.col("allele"), F.col("quality")]
    return fl.capped(t.obs, ["pos"], 5, order).select("pos", "sample", "allele", "read")


ADAPTERS = ["ention", "the an"]


def _trim_sql(col: str, left: int, right: int) -> str:
    best = lambda parts, f: "CASE " + " ".join(f"WHEN {f}({col}, '{p}') THEN {len(p)}" for p in sorted(set(parts), key=len, reverse=True)) + " ELSE 0 END"
    lead = best([a[:n] for a in ADAPTERS for n in range(left, len(a) + 1)], "starts_with")
    tail = best([a[-n:] for a in ADAPTERS for n in range(right, len(a) + 1)], "ends_with")
    inside = " OR ".join(f"contains('{a}', {col})" for a in ADAPTERS)
    return f"CASE WHEN {inside} THEN '' WHEN length({col}) - ({lead}) - ({tail}) > 0 THEN substr({col}, ({lead}) + 1, length({col}) - ({lead}) - ({tail})) ELSE '' END"


@query(f"WITH r AS (SELECT doc_id, lower(text) AS seq FROM documents) SELECT doc_id, {_trim_sql('seq', 2, 2)} AS trimmed FROM r")
def trim_adapter(t):
    reads = t["documents"].select("doc_id", F.lower("text").alias("seq"))
    return reads.select("doc_id", fl.trimmed(F.col("seq"), ADAPTERS, 2, 2).alias("trimmed"))


@query("SELECT doc_id, substr(text, 4, 20) AS seq FROM documents WHERE length(text) BETWEEN 100 AND 2000")
def reformat_reads(t):
    return fl.reformatted(t["documents"].select("doc_id", F.col("text").alias("seq")), "seq", None, 100, 2000, 3, 20)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '[13579]$')")
def grep_filter(t):
    return fl.without_lines(t["customer"].select("c_custkey", "c_name"), "c_name", "[13579]$")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def informative_columns(t):
    df = t["orders"].select("o_orderkey", "o_totalprice", (F.col("o_custkey") * 0).alias("zero"), F.lit(float("nan")).alias("nan"))
    return fl.informative(df, ["o_totalprice", "zero", "nan"])


CODES = ["BUILDING", "MACHINES", "AUTOMOBI", "HOUSEHOL"]


@query(f"""WITH r AS (SELECT c_custkey, substr(c_mktsegment, 1, 8) || c_name AS seq FROM customer),
  m AS (SELECT c_custkey, seq, code, i, CASE WHEN length(seq) >= 8 THEN hamming(substr(seq, 1, 8), code) ELSE 1048576 END AS d FROM r, (SELECT unnest({CODES}) AS code, unnest([0, 1, 2, 3]) AS i)),
  b AS (SELECT c_custkey, seq, min(d) AS d, arg_min(i, d * 10 + i) AS i FROM m GROUP BY ALL),
  n AS (SELECT b.*, (SELECT count(*) FROM m WHERE m.c_custkey = b.c_custkey AND m.d = b.d) AS k FROM b)
  SELECT c_custkey, seq, CASE WHEN d <= 3 AND k = 1 THEN CAST(i AS INT) END AS barcode, CASE WHEN d <= 3 THEN CAST(d AS INT) END AS mismatches, d <= 3 AND k > 1 AS ambiguous,
   CASE WHEN d <= 3 AND k = 1 THEN substr(seq, 9) ELSE seq END AS rest FROM n""")
def hamming_barcode(t):
    reads = t["customer"].select("c_custkey", F.concat(F.substring("c_mktsegment", 1, 8), "c_name").alias("seq"))
    return fl.barcodes(reads, "seq", CODES, 3)


@query("SELECT l_suppkey, l_partkey, rank, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)) WHERE rank <= 5")
def topk_unique(t):
    df = t["lineitem"].select("l_suppkey", "l_partkey", "l_extendedprice")
    return fl.top_unique(df, ["l_suppkey"], "l_partkey", "l_extendedprice", 5).withColumn("rank", F.col("rank").cast("long"))


# pileup

COUNTS = f"{OBS}, counts AS (SELECT pos, sample, allele, count(*) AS n, CAST(count(*) FILTER (strand = 'O') AS BIGINT) AS forward, CAST(count(*) FILTER (strand <> 'O') AS BIGINT) AS reverse FROM obs GROUP BY ALL)"


def counts(t: Tables):
    return pu.allele_counts(t.obs, pu.SITE, "allele", F.col("strand") == "O")


@query(f"WITH {COUNTS} SELECT * FROM counts")
def pileup_counts(t):
    return counts(t)


def _kept(df):
    return df.select("pos", "sample", "allele", "n", "removed")


def _kept_sql(ctes: str, gone: str, source: str = "x") -> str:
    return f"WITH {COUNTS}{ctes} SELECT pos, sample, allele, CASE WHEN {gone} THEN 0 ELSE n END AS n, CASE WHEN {gone} THEN n ELSE 0 END AS removed FROM {source}"


@query(_kept_sql(", x AS (SELECT *, max(n) OVER (PARTITION BY pos, sample) // 4 AS m FROM counts)", "n > 0 AND n < m"))
def quarter_filter(t):
    return _kept(pu.at_least_a_quarter(pu.started(counts(t))))


@query(_kept_sql(""", a AS (SELECT *, max(n) OVER (PARTITION BY pos, sample) AS m1 FROM counts), b AS (SELECT *, coalesce(max(CASE WHEN n < m1 THEN n END) OVER (PARTITION BY pos, sample), -1) AS m2 FROM a),
  x AS (SELECT *, CASE WHEN sum(CASE WHEN n IN (m1, m2) THEN 1 ELSE 0 END) OVER (PARTITION BY pos, sample) > 2 THEN -1 ELSE m2 END AS m3 FROM b)""", "n <> m1 AND n <> m3"))
def diploid_filter(t):
    return _kept(pu.diploid(pu.started(counts(t))))


@query(_kept_sql("", "n >= 3 AND (forward = 0 OR reverse = 0)", "counts"))
def strand_bias_filter(t):
    return _kept(pu.strand_bias(pu.started(counts(t)), 2))


@query(f"""WITH {COUNTS}, a AS (SELECT *, CASE WHEN n >= 3 AND (forward = 0 OR reverse = 0) THEN n ELSE 0 END AS r1 FROM counts), b AS (SELECT pos, sample, allele, n - r1 AS n, r1, 2 * (1 + sum(r1) OVER (PARTITION BY pos, sample)) AS t FROM a)
  SELECT pos, sample, allele, CASE WHEN n > 0 AND n < t THEN 0 ELSE n END AS n, r1 + CASE WHEN n > 0 AND n < t THEN n ELSE 0 END AS removed FROM b""")
def leftover_filter(t):
    return _kept(fl.chain(pu.started(counts(t)), [lambda c: pu.strand_bias(c, 2), lambda c: pu.leftover(c, 1)]))


@query(f"WITH {OBS} SELECT pos, sample, allele, read, quality FROM obs WHERE allele = 0 OR quality >= 30")
def quality_filter(t):
    return pu.low_quality(t.obs, "quality", F.col("allele") == 0).select("pos", "sample", "allele", "read", "quality")


@query(f"""WITH {OBS}, x AS (SELECT *, CAST(count(*) OVER (PARTITION BY pos, sample, allele) AS DOUBLE) / count(*) OVER (PARTITION BY pos, sample) AS share FROM obs)
  SELECT pos, sample, allele, read, quality FROM x WHERE NOT (allele <> 0 AND quality < 30 AND CAST((read * 7919) % 10007 AS DOUBLE) / 10007 > share)""")
def quality_filter_guarded(t):
    guard = (F.col("read") * 7919 % 10007).cast("double") / 10007
    return pu.low_quality(t.obs, "quality", F.col("allele") == 0, guard=guard).select("pos", "sample", "allele", "read", "quality")


@query(_kept_sql(", d AS (SELECT DISTINCT pos + i AS pos, sample FROM obs, (SELECT unnest([1, 2]) AS i) WHERE quality = 50), x AS (SELECT c.*, d.pos IS NOT NULL AS g FROM counts c LEFT JOIN d ON d.pos = c.pos AND d.sample = c.sample)", "g"))
def inside_indel_filter(t):
    indels = t.obs.where("quality = 50").select("pos", "sample", F.lit(2).cast("long").alias("length"))
    return _kept(pu.inside_indels(pu.started(counts(t)), indels))


@query(f"WITH {OBS}, i AS (SELECT pos, sample, quality % 6 AS indel, count(*) FILTER (strand = 'O') + count(*) FILTER (strand <> 'O') AS n FROM obs GROUP BY ALL) SELECT pos, sample, indel, n FROM i QUALIFY count(*) OVER (PARTITION BY pos, sample) <= 3")
def entropic_indel_filter(t):
    i = pu.allele_counts(t.obs.withColumn("indel", F.col("quality") % 6), pu.SITE, "indel", F.col("strand") == "O").drop("n")
    return pu.entropic_indels(i, 3).select("pos", "sample", "indel", "n")


@query(f"WITH {OBS} SELECT pos, count(DISTINCT read_index) AS distinct_indices, count(*) AS variants FROM obs WHERE allele <> 0 GROUP BY pos HAVING count(DISTINCT read_index) >= 3 AND count(*) > 10")
def site_gate(t):
    return pu.site_gate(t.obs, "pos", F.col("allele") != 0)


@query(f"""WITH {OBS}, e AS (SELECT pos, grp, allele, count(*) AS n FROM obs GROUP BY ALL), d AS (SELECT pos, grp, count(DISTINCT read_index) FILTER (allele <> 0) AS k FROM obs GROUP BY ALL)
  SELECT e.pos, e.grp, CAST(coalesce(sum(n) FILTER (allele = 0), 0) AS BIGINT) AS ref_count, CAST(coalesce(sum(n) FILTER (allele <> 0), 0) AS BIGINT) AS var_count, CAST(any_value(d.k) AS INT) AS distinct_read_indices,
   coalesce(string_agg(n || ':0/' || allele, ',' ORDER BY n DESC, allele) FILTER (allele <> 0), '') AS variations FROM e JOIN d ON d.pos = e.pos AND d.grp = e.grp GROUP BY e.pos, e.grp""")
def variation_summary(t):
    return pu.group_variations(t.obs, "pos", "grp", "allele", F.lit(0).cast("long"))


@query(f"""WITH {COUNTS}, a AS (SELECT pos, sample, list_sort(list(allele) FILTER (n >= 2)) AS al, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS good, sum(CASE WHEN n < 2 THEN n ELSE 0 END) AS bad FROM counts GROUP BY ALL), b AS (SELECT *, coalesce(len(al), 0) AS k, array_to_string(al, '/') AS s FROM a)
  SELECT pos, sample, CASE WHEN k = 0 THEN './.' WHEN k = 1 THEN s || '/' || s ELSE s END AS genotype, CASE k WHEN 0 THEN 'not-typed' WHEN 1 THEN 'homozygous' WHEN 2 THEN 'heterozygous' ELSE 'Mixture' END AS zygosity, CAST(good AS BIGINT) AS n_good, CAST(bad AS BIGINT) AS n_failed FROM b""")
def genotypes(t):
    c = pu.leftover(pu.started(counts(t)), 1)
    return pu.genotypes(c, F.lit(0))


@query(f"WITH {COUNTS}, r AS (SELECT pos, sample, CAST(coalesce(sum(n) FILTER (allele = 0), 0) AS DOUBLE) / sum(n) AS rp FROM counts GROUP BY ALL) SELECT pos, CASE WHEN sample = 'N' THEN 'B' ELSE 'A' END AS grp, round(avg(rp), 6) AS group_rp, count(*) AS samples FROM r GROUP BY ALL")
def allele_frequencies(t):
    got = pu.allele_frequency(counts(t), F.col("allele") == 0, F.when(F.col("sample") == "N", "B").otherwise("A"))
    return got.withColumn("group_rp", F.round("group_rp", 6))


@query(f"""WITH {OBS}, s AS (SELECT pos, sample, count(*) AS bases, count(*) FILTER (quality > 25) AS k FROM obs GROUP BY ALL)
  SELECT pos // 100 AS slice, sample, CAST(sum(CASE WHEN bases >= 5 AND k >= greatest(5.0, CAST(bases AS DOUBLE) / 3) THEN 1 ELSE 0 END) AS BIGINT) AS indels, CAST(sum(CASE WHEN bases >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS sites,
   round(100000.0 * sum(CASE WHEN bases >= 5 AND k >= greatest(5.0, CAST(bases AS DOUBLE) / 3) THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN bases >= 5 THEN 1 ELSE 0 END), 0), 4) AS rate FROM s GROUP BY ALL""")
def indel_rates(t):
    s = t.obs.groupBy("pos", "sample").agg(F.count("*").alias("bases"), F.sum((F.col("quality") > 25).cast("long")).alias("indel_count"))
    return pu.indel_rate(s, 100).withColumn("rate", F.round("rate", 4))


# sets and joins of data sets

TWO = f"{ALN}, a AS (SELECT query, max(target) AS target, max(length) AS score FROM aln WHERE sample <> 'R' GROUP BY query), b AS (SELECT query, max(target) AS target, max(length) AS score FROM aln WHERE sample <> 'A' GROUP BY query)"


def two(t: Tables):
    pick = lambda s: t.aln.where(F.col("sample") != s).groupBy("query").agg(F.max("target").alias("target"), F.max("length").alias("score"))
    return pick("R"), pick("A")


@query(f"""WITH {TWO} SELECT coalesce(a.query, b.query) AS query, CASE WHEN b.query IS NULL THEN 'only_a' WHEN a.query IS NULL THEN 'only_b' WHEN a.target <> b.target THEN 'target' WHEN a.score <> b.score THEN 'score' ELSE 'same' END AS class
  FROM a FULL JOIN b ON a.query = b.query""")
def diff_alignments(t):
    return st.diff(*two(t), "query", ["target", "score"])


@query(f"WITH {TWO} SELECT query FROM a INTERSECT SELECT query FROM b")
def diff_common(t):
    a, b = two(t)
    return a.select("query").intersect(b.select("query"))


@query(f"WITH {TWO} SELECT query FROM a EXCEPT SELECT query FROM b")
def diff_unique(t):
    a, b = two(t)
    return st.only_in(a, b, "query").select("query")


@query("""WITH v AS (SELECT l_partkey AS pos, l_returnflag AS file, list_sort(list(DISTINCT l_linenumber % 4)) AS alleles FROM lineitem GROUP BY ALL), a AS (SELECT * FROM v WHERE file = 'A'), b AS (SELECT * FROM v WHERE file = 'R'),
  j AS (SELECT a.pos, len(list_filter(a.alleles, lambda x: NOT list_contains(b.alleles, x))) AS missed, len(list_filter(b.alleles, lambda x: NOT list_contains(a.alleles, x))) AS extra FROM a JOIN b USING (pos))
  SELECT pos, CASE WHEN missed = 0 AND extra = 0 THEN 'agree' WHEN missed = 1 THEN 'missed_one' WHEN missed = 2 THEN 'missed_two' WHEN missed > 2 THEN 'missed_more' ELSE 'other' END AS class FROM j""")
def vcf_compare_classes(t):
    v = t["lineitem"].groupBy(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("file")).agg(F.collect_set(F.col("l_linenumber") % 4).alias("alleles"))
    return st.compare_calls(v.where("file = 'A'"), v.where("file = 'R'"), ["pos"], "alleles").select("pos", "class")


@query(f"WITH {ALN} SELECT query, number, 0 AS source FROM aln WHERE sample = 'A' UNION ALL SELECT query, number, 1 FROM aln WHERE sample = 'R'")
def concat_union(t):
    return st.concatenated([t.aln.where(F.col("sample") == s).select("query", "number") for s in "AR"])


@query(f"WITH {ALN}, u AS (SELECT query, number, length AS score, CASE sample WHEN 'A' THEN 0 ELSE 1 END AS source FROM aln WHERE sample IN ('A', 'R')) SELECT * FROM (SELECT * FROM u QUALIFY score = max(score) OVER (PARTITION BY query)) QUALIFY count(*) OVER (PARTITION BY query) <= 2")
def merge_best(t):
    u = st.concatenated([t.aln.where(F.col("sample") == s).select("query", "number", F.col("length").alias("score")) for s in "AR"])
    return fl.best_score(u, "query", "score", 2)


@query(f"WITH {TWO} SELECT query, a.target AS target_a, b.target AS target_b FROM a JOIN b USING (query)")
def read_pairs(t):
    a, b = two(t)
    return st.paired(a, b, "query", ["target"])


@query(f"WITH {ALN}, {ANN} SELECT DISTINCT target FROM aln WHERE target NOT IN (SELECT target FROM ann WHERE target < 7)")
def targets_missing(t):
    return st.only_in(t.aln.select("target").distinct(), t.ann.where("target < 7").select("target"), "target")


@query("SELECT c_name, c_mktsegment, dense_rank() OVER (ORDER BY c_name) - 1 AS name_index FROM customer")
def name_to_index(t):
    return st.indexed(t["customer"].select("c_name", "c_mktsegment"), "c_name", "name_index")


@query("SELECT gene, segment, (row_number() OVER (PARTITION BY gene ORDER BY segment) - 1) % 4 AS part FROM (SELECT o_custkey AS gene, o_orderkey AS segment FROM orders)")
def split_transcripts(t):
    return st.spread(t["orders"].select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("segment")), "gene", "segment", 4)


@query("SELECT query, CAST(sum(m) AS BIGINT) AS multiplicity FROM (SELECT l_orderkey AS query, count(*) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL UNION ALL SELECT l_orderkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY query")
def read_set_union(t):
    sets = [t["lineitem"].where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("query")).agg(F.count("*").alias("multiplicity")) for f in "AR"]
    return st.set_union(sets, "query")


@query("""SELECT 'chromosome' || ' ' || l_suppkey AS id, l_partkey AS pos, l_returnflag AS only_first, CAST(NULL AS VARCHAR) AS only_second FROM lineitem WHERE l_linenumber = 7
  UNION ALL SELECT 'chromosome' || ' ' || l_suppkey, l_partkey, NULL, l_linestatus FROM lineitem WHERE l_linenumber = 6""")
def schema_union(t):
    own = lambda n, c, a: t["lineitem"].where(F.col("l_linenumber") == n).select(F.concat(F.lit("chromosome "), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_partkey").alias("pos"), F.col(c).alias(a))
    return st.schema_union([own(7, "l_returnflag", "only_first"), own(6, "l_linestatus", "only_second")])


@query(f"WITH {SITES} SELECT id, target, pos FROM sites ORDER BY target, pos, id LIMIT 100")
def sorted_limit(t):
    return t.sites.select("id", "target", "pos").orderBy("target", "pos", "id").limit(100)
