"""Known variants, pileup views, element pairs and formulas over step functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociform.operators import coverage as cov
from lociform.operators import lookups as lo
from lociform.plans.bindings import ALN, OBS, runs_of
from lociform.plans.interval_queries import KEYS, _two_sql, runs
from lociform.plans.registry import query
from lociform.plans.sequence_queries import READS, reads


@query(f"WITH {OBS} SELECT pos, array_to_string(list_sort(list(DISTINCT allele)), '/') AS alleles FROM obs GROUP BY pos")
def genotype_map(t):
    return lo.variant_map(t.obs, ["pos"], "allele").select("pos", F.array_join(F.transform("alleles", lambda a: a.cast("string")), "/").alias("alleles"))


@query("SELECT DISTINCT p_partkey % 500 AS pos FROM part WHERE length(p_brand) <> length(p_name)")
def known_indels(t):
    own = t["part"].withColumn("pos", F.col("p_partkey") % 500)
    return lo.indel_positions(own, ["pos"], "p_brand", F.array("p_name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AS known FROM lineitem")
def known_positions(t):
    own = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    known = t["lineitem"].where("l_quantity > 48").select("l_partkey")
    return lo.with_known(own, known, ["l_partkey"]).select("l_orderkey", "l_linenumber", "known")


@query(f"""WITH {READS}, p AS (SELECT doc_id, doc_id % 50 AS start, seq FROM reads)
  SELECT doc_id, rpad(repeat(' ', CAST(greatest(start - 20, 0) AS INT)) || substr(seq, CAST(greatest(20 - start, 0) AS INT) + 1), 40, ' ') AS line FROM p WHERE start < 60 AND start + length(seq) > 20""")
def pileup_view(t):
    own = reads(t).select("doc_id", (F.col("doc_id") % 50).alias("start"), "seq")
    return lo.pileup_view(own, "start", "seq", 20, 60).select("doc_id", "line")


@query("""WITH v AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 20)
  SELECT p_partkey AS a, p_partkey + 1 AS b, round(log2(x.n) - log2(y.n), 6) AS log2_difference FROM part JOIN v x ON x.k = p_partkey JOIN v y ON y.k = p_partkey + 1""")
def element_pairs(t):
    v = t["lineitem"].groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    pairs = t["part"].select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return lo.pair_differences(v, pairs, "k", "n", 20).withColumn("log2_difference", F.round("log2_difference", 6))


@query(f"""WITH {ALN}, {runs_of('aln', 'ra')}, {runs_of('aln', 'rb', weight='CAST(round(discount * 100) AS BIGINT)')}, {_two_sql('ra', 'rb')}
  SELECT target, CAST(sum(length) AS BIGINT) AS bases, round(sum(length * (a / (1.0 + b / 100.0))), 2) AS corrected FROM both_ WHERE a > 0 GROUP BY target""")
def formula_coverage(t):
    """Depth over one plus the mean weight, by target (A3)."""
    weighted = cov.coverage(t.aln, KEYS, "start", "end", F.round(F.col("discount") * 100).cast("long"), leading=False)
    both = cov.step_union({"a": runs(t), "b": weighted}, KEYS).where("a > 0")
    corrected = F.sum(F.col("length") * (F.col("a") / (1.0 + F.col("b") / 100.0)))
    return both.groupBy("target").agg(F.sum("length").alias("bases"), F.round(corrected, 2).alias("corrected"))
