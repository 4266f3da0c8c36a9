"""Reads, scalars on sequences, windows, methylation, variants and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.operators import discovery as di
from lociform.operators import reads as rd
from lociform.operators import sets as se
from lociform.operators import statistics as stat
from lociform.operators import variants as va
from lociform.operators import windows as wi
from lociform.plans.bindings import ALN, EXONS, OBS, SITES, Tables
from lociform.plans.registry import query

SEQ = "translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac')"
READS = f"reads AS (SELECT doc_id, upper(regexp_replace({SEQ}, '[^acgt]', '', 'g')) AS seq, regexp_replace(text, '[^!-~]', '', 'g') AS quality FROM documents)"


def reads(t: Tables):
    return t["documents"].select("doc_id", sq.letters_as_bases("text").alias("seq"), F.regexp_replace("text", "[^!-~]", "").alias("quality"))


@query(f"WITH {READS} SELECT seq, count(*) AS n FROM reads GROUP BY seq")
def tally_duplicates(t):
    return rd.tally(reads(t), "seq")


@query(f"""WITH {READS}, e AS (SELECT substr(seq, i, 2) AS here FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM reads)), h AS (SELECT here, count(*) AS n FROM e GROUP BY here)
  SELECT w AS word, CAST(sum(CASE WHEN starts_with(here, w) THEN n ELSE 0 END) AS BIGINT) AS n FROM h, (SELECT unnest(['A', 'C', 'G', 'T', 'CG', 'CA', 'AA']) AS w) GROUP BY w""")
def base_composition(t):
    return rd.composition(reads(t), "seq", ["A", "C", "G", "T", "CG", "CA", "AA"])


@query(f"""WITH {READS}, e AS (SELECT i - 1 AS position, ascii(substr(quality, i, 1)) - 33 AS score FROM (SELECT quality, unnest(range(1, length(quality) + 1)) AS i FROM reads)),
  h AS (SELECT position, score, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY position ORDER BY score) AS upto, sum(n) OVER (PARTITION BY position) AS tot FROM h)
  SELECT CAST(position AS INT) AS position, round(CAST(sum(score * n) AS DOUBLE) / sum(n), 6) AS mean, CAST(min(score) FILTER (upto * 100 >= tot * 25) AS INT) AS q25, CAST(min(score) FILTER (upto * 100 >= tot * 50) AS INT) AS q50, CAST(min(score) FILTER (upto * 100 >= tot * 75) AS INT) AS q75 FROM r GROUP BY position""")
def quality_percentiles(t):
    return rd.quality_by_position(reads(t), "quality").withColumn("mean", F.round("mean", 6))


@query(f"WITH {ALN} SELECT count(*) AS rows, CAST(sum(length) AS BIGINT) AS bases, min(length) AS shortest, max(length) AS longest, round(avg(length), 6) AS mean, round(avg(CASE WHEN strand = 'O' THEN 1 ELSE 0 END), 6) AS reverse_share FROM aln")
def stats_overview(t):
    return rd.overview(t.aln, "length", {"reverse_share": F.col("strand") == "O"}).withColumns({c: F.round(c, 6) for c in ("mean", "reverse_share")})


@query(f"WITH {ALN} SELECT count(DISTINCT query) AS \"distinct\" FROM aln")
def distinct_queries(t):
    return rd.distinct_count(t.aln, "query")


@query(f"WITH {READS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS reverse_complement, translate(seq, 'C', 'T') AS bisulfite, CASE WHEN length(seq) > 0 THEN round(length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length(seq) AS DOUBLE), 6) END AS gc, CASE WHEN length(seq) > 0 THEN round(10.4436 - 8.266972 * (length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length(seq) AS DOUBLE)), 6) END AS correction FROM reads")
def sequence_scalars(t):
    s = F.col("seq")
    return reads(t).select("doc_id", sq.reverse_complement(s).alias("reverse_complement"), sq.bisulfite(s).alias("bisulfite"), F.round(sq.base_share(s, "GC"), 6).alias("gc"), F.round(sq.gc_correction(s), 6).alias("correction"))


@query(f"WITH {READS} SELECT doc_id, seq AS decoded FROM reads")
def color_space_round_trip(t):
    return reads(t).select("doc_id", sq.color_decode(sq.color_encode(F.col("seq"))).alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big, concat_ws('|', CASE WHEN (CAST(l_quantity AS INT) & 1) <> 0 THEN 'PAIRED' END, CASE WHEN (CAST(l_quantity AS INT) & 2) <> 0 THEN 'PROPERLY_PAIRED' END, CASE WHEN (CAST(l_quantity AS INT) & 4) <> 0 THEN 'READ_UNMAPPED' END, CASE WHEN (CAST(l_quantity AS INT) & 8) <> 0 THEN 'MATE_UNMAPPED' END, CASE WHEN (CAST(l_quantity AS INT) & 16) <> 0 THEN 'READ_REVERSE_STRAND' END, CASE WHEN (CAST(l_quantity AS INT) & 32) <> 0 THEN 'MATE_REVERSE_STRAND' END) AS names FROM lineitem")
def flag_strings(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("big"), sq.flag_names(F.col("l_quantity").cast("int")).alias("names"))


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, 'A' AS ref, 'C,GT' AS alts, (l_linenumber % 3) || '/' || (l_orderkey % 3) AS code FROM lineitem), d AS (SELECT *, string_split(ref || ',' || alts, ',') AS al FROM g)
  SELECT k, n, al[CAST(substr(code, 1, 1) AS INT) + 1] || '/' || al[CAST(substr(code, 3, 1) AS INT) + 1] AS alleles, code AS coded FROM d""")
def genotype_codes(t):
    code = F.concat_ws("/", (F.col("l_linenumber") % 3).cast("string"), (F.col("l_orderkey") % 3).cast("string"))
    al = sq.decoded_genotype(code, F.lit("A"), F.lit("C,GT"))
    return t["lineitem"].select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), al.alias("alleles"), sq.coded_genotype(al, F.lit("A"), F.lit("C,GT")).alias("coded"))


@query(f"""WITH {READS}, e AS (SELECT p, substr(seq, p, 4) AS word FROM reads, (SELECT unnest([1, 2, 20, 21, 22]) AS p) WHERE length(substr(seq, p, 4)) = 4), f AS (SELECT p, word, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY p) AS f FROM e GROUP BY p, word)
  SELECT word, round((coalesce(sum(f) FILTER (p >= 20), 0) / 3) / (sum(f) FILTER (p < 20) / 2), 6) AS weight FROM f GROUP BY word HAVING sum(f) FILTER (p < 20) > 0""")
def word_weights(t):
    return rd.words_at(reads(t), "seq", 4, (1, 2), (20, 22)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {OBS} SELECT pos, count(*) FILTER (allele = 0) AS \"0\", count(*) FILTER (allele = 1) AS \"1\", count(*) FILTER (allele = 2) AS \"2\", count(*) FILTER (allele = 3) AS \"3\" FROM obs GROUP BY pos")
def frequency_table(t):
    return rd.frequency_table(t.obs, "pos", "allele", [0, 1, 2, 3])


@query(f"WITH {OBS}, h AS (SELECT pos, quality, count(*) AS f FROM obs GROUP BY ALL) SELECT pos, string_agg(quality || ':' || f, ',' ORDER BY quality) AS histogram FROM h GROUP BY pos")
def value_histogram(t):
    h = rd.histogram(t.obs, ["pos"], "quality")
    return h.select("pos", F.array_join(F.transform("histogram", lambda x: F.concat_ws(":", x["number"].cast("string"), x["frequency"].cast("string"))), ",").alias("histogram"))


@query(f"WITH {OBS} SELECT pos, count(DISTINCT sample) AS samples, CAST(count(DISTINCT sample || ':' || allele) AS BIGINT) AS alleles FROM obs GROUP BY pos")
def base_information(t):
    b = rd.base_information(t.obs, ["quality", "read_index"])
    return b.select("pos", F.size("samples").cast("long").alias("samples"), F.aggregate("samples", F.lit(0), lambda a, s: a + F.size(s["counts"])).cast("long").alias("alleles"))


@query(f"WITH {OBS} SELECT 'quality' AS property, CAST(min(quality) AS DOUBLE) AS least, CAST(max(quality) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'read_index', CAST(min(read_index) AS DOUBLE), CAST(max(read_index) AS DOUBLE) FROM obs")
def property_extremes(t):
    return rd.extremes(t.obs, ["quality", "read_index"])


@query(f"WITH {OBS} SELECT read_index, sample, count(*) FILTER (allele <> 0) AS variants, count(*) FILTER (allele = 0) AS reference FROM obs GROUP BY ALL")
def variation_by_cycle(t):
    return di.by_read_index(t.obs)


@query(f"WITH {READS}, g AS (SELECT doc_id % 5 AS target, string_agg(seq, '' ORDER BY doc_id) AS seq FROM reads GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS target, l_partkey % 900 AS pos FROM lineitem) SELECT l_orderkey, l_linenumber, substr(seq, CAST(pos AS INT) + 1, 6) AS bases FROM p JOIN g USING (target)")
def genome_lookup(t):
    g = rd.joined_blocks(reads(t).withColumn("name", F.col("doc_id") % 5), "name", "doc_id", "seq", 256)
    points = t["lineitem"].select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("target"), (F.col("l_partkey") % 900).alias("pos"))
    return rd.genome_get(points, g, "target", "pos", 6, 256).select("l_orderkey", "l_linenumber", "bases")


@query(f"WITH {READS}, w AS (SELECT substr(seq, i, 12) AS word FROM (SELECT seq, unnest(range(1, length(seq) - 10)) AS i FROM reads)) SELECT r.doc_id, count(*) AS hits FROM reads r JOIN w ON w.word = substr(r.seq, 1, 12) GROUP BY r.doc_id")
def seed_hits(t):
    g = rd.genome_blocks(reads(t), "doc_id", "seq", 256)
    return rd.seed_counts(reads(t).select("doc_id", "seq"), g, "seq", 12).groupBy("doc_id").agg(F.sum("hits").alias("hits"))


@query("SELECT l_returnflag, count(*) FILTER (l_suppkey % 2 = 0) AS x, count(*) FILTER (l_suppkey % 10 = 1) AS y, round(CAST(count(*) FILTER (l_suppkey % 2 = 0) AS DOUBLE) / count(*) FILTER (l_suppkey % 10 = 1), 6) AS ratio, CASE WHEN CAST(count(*) FILTER (l_suppkey % 2 = 0) AS DOUBLE) / count(*) FILTER (l_suppkey % 10 = 1) >= 5 THEN 'female' ELSE 'male' END AS sex FROM lineitem GROUP BY l_returnflag")
def sex_ratio(t):
    c = F.when(F.col("l_suppkey") % 2 == 0, "X").when(F.col("l_suppkey") % 10 == 1, "Y").otherwise("1")
    return rd.sex_ratio(t["lineitem"].withColumn("chrom", c), "l_returnflag", "chrom", threshold=5).withColumn("ratio", F.round("ratio", 6))


@query("SELECT p_partkey, least(p_size, 24) AS a, CASE WHEN upper(substr(p_name, 1, 1)) IN ('A', 'C', 'G', 'T') THEN 'Cp' || upper(substr(p_name, 1, 1)) ELSE 'CpN' END AS context, CASE WHEN ((ascii(substr(p_brand, 7, 1)) * 3) % 2) = 0 THEN true ELSE false END AS even FROM part")
def genomic_context(t):
    return t["part"].select("p_partkey", F.least("p_size", F.lit(24)).alias("a"), sq.context(F.substring("p_name", 1, 1)).alias("context"), (F.ascii(F.substring("p_brand", 7, 1)) * 3 % 2 == 0).alias("even"))


# windows and folds


@query(f"WITH {SITES} SELECT target, id, pos, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM sites WINDOW w AS (PARTITION BY target ORDER BY pos RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def sites_in_window(t):
    got = wi.trailing_sums(t.sites, ["target"], "pos", 3600, {"n": F.lit(1).cast("long"), "total": F.col("value")})
    return got.select("target", "id", "pos", "n", F.round("total", 4).alias("total"))


@query(f"WITH {SITES} SELECT target, id, round(max(value) OVER w, 6) AS top FROM sites WINDOW w AS (PARTITION BY target ORDER BY pos, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_n_sites(t):
    return wi.last_sites(t.sites, ["target"], ["pos", "id"], 10, {"top": F.max("value")}).select("target", "id", F.round("top", 6).alias("top"))


@query(f"WITH {SITES}, d AS (SELECT DISTINCT target, pos FROM sites) SELECT target, pos, pos - lag(pos) OVER (PARTITION BY target ORDER BY pos) AS distance FROM d")
def previous_distance(t):
    return wi.previous_distance(t.sites.select("target", "pos").distinct(), ["target"], "pos")


def _anchor_sql(last: bool) -> str:
    a = "o.e" if last else "a.anchor"
    return f"""WITH RECURSIVE {EXONS}, o AS (SELECT target, start AS s, "end" AS e, row_number() OVER (PARTITION BY target ORDER BY start, "end") AS r FROM exons),
  a AS (SELECT target, r, s AS start, e, e AS anchor, 1 AS run FROM o WHERE r = 1 UNION ALL SELECT o.target, o.r, CASE WHEN o.s - a.anchor <= 4 THEN a.start ELSE o.s END, o.e, CASE WHEN o.s - a.anchor <= 4 THEN {a} ELSE o.e END, a.run + CASE WHEN o.s - a.anchor <= 4 THEN 0 ELSE 1 END
   FROM a JOIN o ON o.target = a.target AND o.r = a.r + 1) SELECT target, min(start) AS start, max(e) AS "end", count(*) AS n FROM a GROUP BY target, run"""


@query(_anchor_sql(False))
def peak_anchor_merge(t):
    return wi.anchored(t.exons, ["target"], 4)


@query(_anchor_sql(True))
def peak_chain_merge(t):
    return wi.anchored(t.exons, ["target"], 4, "last")


@query(f"""WITH RECURSIVE {EXONS}, v AS (SELECT target, start AS s, "end" AS e, CAST(count(*) AS DOUBLE) AS v FROM exons GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY s, e) AS r FROM v),
  a AS (SELECT target, r, s AS start, e, v AS anchor, 1 AS run FROM o WHERE r = 1 UNION ALL SELECT o.target, o.r, CASE WHEN abs(o.v - a.anchor) <= 1 THEN a.start ELSE o.s END, o.e, CASE WHEN abs(o.v - a.anchor) <= 1 THEN a.anchor ELSE o.v END, a.run + CASE WHEN abs(o.v - a.anchor) <= 1 THEN 0 ELSE 1 END
   FROM a JOIN o ON o.target = a.target AND o.r = a.r + 1) SELECT target, min(start) AS start, max(e) AS "end", count(*) AS n FROM a GROUP BY target, run""")
def peak_value_merge(t):
    own = t.exons.groupBy("target", "start", "end").agg(F.count("*").cast("double").alias("value"))
    return wi.by_difference(own, ["target"], "value", 1.0)


@query(f"""WITH {ALN}, c AS (SELECT target, start AS pos, count(*) AS n FROM aln GROUP BY ALL), r AS (SELECT target, pos, coalesce(sum(n) OVER (ORDER BY target, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS tot FROM c),
  s AS (SELECT *, CAST(floor(b * 12 / tot) AS INT) AS slice FROM r) SELECT slice, target, min(pos) AS start FROM s WHERE (slice, target) IN (SELECT slice, min(target) FROM s GROUP BY slice) GROUP BY ALL""")
def slice_breakpoints(t):
    return wi.slices(t.aln.select("target", "start"), "target", "start", 12)


# methylation

MET = f"""{OBS}, met AS (SELECT pos, sample, grp, count(*) FILTER (same) AS methylated, count(*) FILTER (NOT same) AS unmethylated FROM (SELECT pos, sample, grp, allele = 0 AS same, strand FROM obs WHERE (pos % 2 = 0 AND strand <> 'O') OR (pos % 2 = 1 AND strand = 'O')) GROUP BY ALL)"""


def met(t: Tables):
    o = t.obs.withColumns({"ref": F.when(F.col("pos") % 2 == 0, "C").otherwise("G")})
    o = o.withColumn("base", F.when(F.col("allele") == 0, F.col("ref")).otherwise("A"))
    return wi.methylation(o, ["pos", "sample", "grp"], "ref", "base", F.col("strand") == "O")


@query(f"WITH {MET} SELECT pos, sample, grp, methylated, unmethylated, round(100.0 * methylated / (methylated + unmethylated), 6) AS rate FROM met")
def methylation_rates(t):
    return met(t).withColumn("rate", F.round("rate", 6))


@query(f"WITH {MET}, reg AS (SELECT i AS region, i * 37 AS start, i * 37 + 50 AS \"end\" FROM (SELECT unnest(range((SELECT max(pos) // 37 + 1 FROM obs))) AS i)) SELECT region, start, \"end\", sample, count(*) AS sites, CAST(sum(methylated) AS BIGINT) AS methylated, CAST(sum(unmethylated) AS BIGINT) AS unmethylated, round(100.0 * sum(methylated) / sum(methylated + unmethylated), 6) AS rate FROM met JOIN reg ON pos >= start AND pos < \"end\" GROUP BY ALL")
def region_methylation(t):
    last = t.obs.agg(F.max("pos")).first()[0]
    reg = t.spark.range(0 if last is None else last // 37 + 1).select(F.lit(0).alias("k"), F.col("id").alias("region"), (F.col("id") * 37).alias("start"), (F.col("id") * 37 + 50).alias("end"))
    got = wi.region_rates(met(t).withColumn("k", F.lit(0)), reg, ["k"], "pos", ["sample"], 32).drop("k")
    return got.withColumn("rate", F.round("rate", 6))


@query(f"WITH {MET} SELECT sample, grp, CAST(sum(methylated) AS BIGINT) AS methylated, CAST(sum(unmethylated) AS BIGINT) AS unmethylated, round(100.0 * sum(methylated) / sum(methylated + unmethylated), 6) AS rate FROM met GROUP BY GROUPING SETS ((sample), (grp))")
def grouping_sets_rates(t):
    return wi.rates_by_sample_and_group(met(t), "sample", "grp").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {MET}, d AS (SELECT *, CASE WHEN methylated + unmethylated >= 5 THEN 2 WHEN methylated + unmethylated >= 2 THEN 1 ELSE 0 END AS depth_class, pos - lag(pos) OVER (PARTITION BY sample, grp ORDER BY pos) AS distance FROM met)
  SELECT depth_class, count(*) AS sites, CAST(sum(methylated) AS BIGINT) AS methylated, CAST(sum(unmethylated) AS BIGINT) AS unmethylated, CAST(sum(CASE WHEN distance <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS near FROM d GROUP BY depth_class""")
def methylation_summary(t):
    return wi.methylation_summary(met(t), ["sample", "grp"], "pos", [2, 5])


@query(f"""WITH {OBS}, s AS (SELECT sample, pos // 50 AS win, strand = 'O' AS reverse, CAST(quality AS DOUBLE) AS rate FROM obs), w AS (SELECT sample, win, sum(rate) FILTER (NOT reverse) AS f, sum(rate) FILTER (reverse) AS r, count(*) FILTER (NOT reverse) AS nf, count(*) FILTER (reverse) AS nr FROM s GROUP BY ALL),
  x AS (SELECT *, abs(f - r) / greatest(nf, nr) AS score FROM w WHERE nf > 0 AND nr > 0), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, win) AS rank FROM x) SELECT sample, win * 50 AS start, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def strand_similarity(t):
    s = t.obs.select("sample", "pos", (F.col("strand") == "O").alias("reverse"), F.col("quality").cast("double").alias("rate"))
    return wi.strand_similarity(s, ["sample"], "pos", 50, 5).withColumn("score", F.round("score", 6))


@query()
def differing_regions(t):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    s = t.obs.groupBy(F.lit("chr1").alias("key"), "pos").agg(n("grp = 'A' AND allele = 0").alias("ma"), n("grp = 'A' AND allele <> 0").alias("ua"), n("grp = 'B' AND allele = 0").alias("mb"), n("grp = 'B' AND allele <> 0").alias("ub"))
    return wi.differing_regions(s, "key", 0.05)


# variants


@query()
def equivalent_indels(t):
    s = reads(t).where("length(seq) > 30")
    i = s.select(F.col("doc_id").alias("target"), (F.col("doc_id") % 20 + 5).alias("start"), F.when(F.col("doc_id") % 2 == 0, F.col("seq").substr((F.col("doc_id") % 20 + 6).cast("int"), F.lit(2))).otherwise("").alias("deleted"), F.when(F.col("doc_id") % 2 == 1, "AC").otherwise("").alias("inserted"), F.col("seq").alias("genome"), F.lit(0).cast("long").alias("offset"))
    return va.equivalent_indels(i)


@query(f"WITH {OBS}, t AS (SELECT pos, count(*) FILTER (sample = 'A') AS a, count(*) FILTER (sample = 'N') AS b FROM obs GROUP BY pos), s AS (SELECT *, sum(a) OVER () AS sa, sum(b) OVER () AS sb FROM t) SELECT pos, round(ln(1 + a) - ln(1 + b) - ln(CAST(sa AS DOUBLE)) + ln(CAST(sb AS DOUBLE)), 6) AS fold FROM s WHERE a + b >= 30")
def tally_bases(t):
    n = lambda s: F.sum((F.col("sample") == s).cast("long"))
    c = t.obs.groupBy("pos").agg(n("A").alias("a"), n("N").alias("b"))
    return stat.tally_bases(c, ["pos"]).select("pos", F.round("fold", 6).alias("fold"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag || l_linestatus) IN ('AF', 'NF') AS ti FROM lineitem")
def transitions(t):
    ref = F.when(F.col("l_returnflag").isin("A", "N") & (F.col("l_linestatus") == "F"), "A").otherwise("C")
    return t["lineitem"].withColumns({"r": ref, "a": F.lit("G")}).select("l_orderkey", "l_linenumber", se.transition("r", "a").alias("ti"))


@query("SELECT l_suppkey % 10 AS target, count(*) AS n, round(log10(count(*) + 1), 6) AS log10_n, CAST(sum(least(CAST(l_quantity AS BIGINT), 30)) AS BIGINT) AS aligned FROM lineitem GROUP BY ALL")
def transcript_counts(t):
    got = t.aln.groupBy("target").agg(F.count("*").alias("n"), F.sum(F.least("length", F.lit(30))).alias("aligned"))
    return got.select("target", "n", F.round(sq.log10p1(F.col("n")), 6).alias("log10_n"), "aligned")


# streaming forms over batches; tests run them as streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(t):
    from lociform.streaming.windows import tumbling

    got = tumbling(_events(t), "ts", ["event_type"], "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o)
  SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def session_islands(t):
    from lociform.streaming.windows import sessions

    return sessions(_events(t), "ts", ["user_id"], "6 hours").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedupe(t):
    from lociform.streaming.windows import deduplicated

    return deduplicated(_events(t), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_id, (event_id * 7919) % 1200 > 900 AS is_late FROM events")
def late_policy(t):
    from lociform.streaming.windows import lateness

    e = _events(t).withColumn("arrival", F.timestamp_seconds(F.unix_seconds("ts") + F.col("event_id") * 7919 % 1200))
    return lateness(e, "ts", "arrival", 900).select("event_id", "is_late")


def _events(t: Tables):
    return t["events"].withColumn("ts", F.col("ts").cast("timestamp"))


