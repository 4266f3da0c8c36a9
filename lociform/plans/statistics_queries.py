"""Normalisation, tests, adjustment, combination and empirical p-values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociform.operators import statistics as st
from lociform.plans.bindings import MATRIX, Tables
from lociform.plans.registry import query

GROUPS = "A=AF,AO/N=NF,NO/R=RF,RO"
GRP = "substr(sample, 1, 1)"


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"WITH {MATRIX} SELECT element, sample, count, round(count / (CAST(length AS DOUBLE) / 1000) / (sum(count) OVER (PARTITION BY sample) / 1e6), 4) AS rpkm, round(log2(count / (CAST(length AS DOUBLE) / 1000) / (sum(count) OVER (PARTITION BY sample) / 1e6) + 1), 6) AS log2_rpkm FROM matrix")
def rpkm(t):
    m = t.matrix.join(st.aligned_totals(t.matrix), "sample")
    value = st.rpkm(F.col("count"), F.col("length"), F.col("total"))
    return m.select("element", "sample", "count", F.round(value, 4).alias("rpkm"), F.round(F.log2(value + 1), 6).alias("log2_rpkm"))


BUQ = f"""{MATRIX}, s AS (SELECT DISTINCT sample FROM matrix), e AS (SELECT DISTINCT element FROM matrix), f AS (SELECT e.element, s.sample, coalesce(m.count, 0) AS count FROM e CROSS JOIN s LEFT JOIN matrix m ON m.element = e.element AND m.sample = s.sample),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY count, element) - 1 AS r, count(*) OVER (PARTITION BY sample) AS n FROM f), q AS (SELECT sample, max(count) FILTER (r = floor(n * 0.75)) AS q, sum(count) AS total FROM r GROUP BY sample),
  buq AS (SELECT sample, greatest(1.0, q * (CAST(sum(total) OVER () AS DOUBLE) / sum(q) OVER ())) AS denominator FROM q)"""


@query(f"WITH {BUQ} SELECT sample, round(denominator, 4) AS denominator FROM buq")
def upper_quartile_norm(t):
    return rounded(st.upper_quartiles(t.matrix), "denominator", places=4)


def values(t: Tables, method: str = "aligned-count"):
    return st.with_groups(st.normalized(t.matrix, method), GROUPS)


VALS = f"{MATRIX}, v AS (SELECT element, sample, {GRP} AS grp, count, (count + 1) / (CAST(length AS DOUBLE) / 1000) / (sum(count) OVER (PARTITION BY sample) / 1e6) AS value FROM matrix)"
AVG = f"{VALS}, g AS (SELECT element, grp, avg(value) AS average, count(*) AS samples FROM v GROUP BY ALL)"


@query(f"WITH {BUQ} SELECT m.element, m.sample, round((m.count + 1) / (CAST(m.length AS DOUBLE) / 1000) / (b.denominator / 1e6), 3) AS value FROM matrix m JOIN buq b USING (sample)")
def normalized_upper_quartile(t):
    return values(t, "bullard-upper-quartile").select("element", "sample", F.round("value", 3).alias("value"))


@query(f"WITH {AVG} SELECT element, grp, round(average, 3) AS average, samples FROM g")
def group_averages(t):
    return rounded(st.group_averages(values(t)), "average", places=3)


FOLD = f"{AVG}, w AS (SELECT element, max(average) FILTER (grp = 'A') AS a, max(average) FILTER (grp = 'R') AS b FROM g GROUP BY element)"


@query(f"WITH {FOLD} SELECT element, round(a / b, 6) AS fold, round(greatest((a + 1e-6) / (b + 1e-6), (b + 1e-6) / (a + 1e-6)), 6) AS magnitude, round(log2(a) - log2(b), 6) AS log2_fold FROM w")
def fold_change(t):
    return rounded(st.fold_changes(st.group_averages(values(t)), "A", "R"), "fold", "magnitude", "log2_fold")


@query(f"WITH {VALS} SELECT element, max(CASE WHEN sample = 'AF' THEN count END) AS count_AF, max(CASE WHEN sample = 'NF' THEN count END) AS count_NF, max(CASE WHEN sample = 'NO' THEN count END) AS count_NO, max(CASE WHEN sample = 'RF' THEN count END) AS count_RF FROM v GROUP BY element")
def expression_pivot(t):
    p = t.matrix.groupBy("element").pivot("sample", ["AF", "NF", "NO", "RF"]).agg(F.max("count"))
    return p.select("element", *(F.col(s).alias(f"count_{s}") for s in ("AF", "NF", "NO", "RF")))


def user_values(t: Tables):
    """Values of two groups with many samples: event values by type and user."""
    e = t["events"].where("event_type IN ('click', 'view', 'purchase')")
    return e.groupBy((F.col("user_id") % 7).cast("string").alias("element"), F.col("user_id").alias("sample"), F.when(F.col("event_type") == "click", "A").otherwise("B").alias("grp")).agg(F.count("*").cast("double").alias("value"))


@query("""WITH v AS (SELECT CAST(user_id % 7 AS VARCHAR) AS element, user_id, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS grp, ln(1 + CAST(count(*) AS DOUBLE)) AS x FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
  m AS (SELECT element, count(*) FILTER (grp = 'A') AS n0, count(*) FILTER (grp = 'B') AS n1, avg(x) FILTER (grp = 'A') AS m0, avg(x) FILTER (grp = 'B') AS m1, var_samp(x) FILTER (grp = 'A') AS v0, var_samp(x) FILTER (grp = 'B') AS v1 FROM v GROUP BY element)
  SELECT element, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 5) AS t_pooled, CAST(n0 + n1 - 2 AS DOUBLE) AS df_pooled, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) AS t_welch,
   round((v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / ((v0 / n0) * (v0 / n0) / (n0 - 1) + (v1 / n1) * (v1 / n1) / (n1 - 1)), 4) AS df_welch FROM m WHERE n0 > 1 AND n1 > 1""")
def t_test_stat(t):
    got = rounded(st.t_tests(user_values(t), "A", "B"), "t_pooled", "t_welch", places=5)
    return rounded(got, "df_welch", places=4)


@query()
def t_test_p(t):
    return st.t_test_p(st.t_tests(user_values(t), "A", "B"))


TABLES = f"{MATRIX}, o AS (SELECT element, CAST(coalesce(sum(count) FILTER ({GRP} = 'A'), 0) AS BIGINT) AS a, CAST(coalesce(sum(count) FILTER ({GRP} = 'R'), 0) AS BIGINT) AS b FROM matrix GROUP BY element), x AS (SELECT element, a, b, CAST(sum(a) OVER () - a AS BIGINT) AS rest_a, CAST(sum(b) OVER () - b AS BIGINT) AS rest_b FROM o)"


def lf(x: str) -> str:
    return f"lgamma(CAST({x} AS DOUBLE) + 1)"


@query(f"""WITH {TABLES}, k AS (SELECT *, unnest(range(greatest(0, a - rest_b), least(a + b, a + rest_a) + 1)) AS k FROM x),
  p AS (SELECT *, exp({lf('a + b')} + {lf('rest_a + rest_b')} + {lf('a + rest_a')} + {lf('b + rest_b')} - {lf('a + b + rest_a + rest_b')} - {lf('k')} - {lf('a + b - k')} - {lf('a + rest_a - k')} - {lf('rest_b - a + k')}) AS w FROM k)
  SELECT element, a, b, rest_a, rest_b, round(least(1.0, sum(w) FILTER (w <= own * (1 + 1e-7))), 5) AS p FROM (SELECT *, max(w) FILTER (k = a) OVER (PARTITION BY element) AS own FROM p) GROUP BY ALL""")
def fisher_2x2(t):
    return rounded(st.fisher(st.two_by_two(st.with_groups(t.matrix, GROUPS), "A", "R")), "p", places=5)


CHI = f"""{MATRIX}, c AS (SELECT element, {GRP} AS grp, sum(count) AS o FROM matrix GROUP BY ALL), s AS (SELECT grp, CAST(sum(o) AS DOUBLE) / sum(sum(o)) OVER () AS share FROM c GROUP BY grp), j AS (SELECT c.*, share, share * sum(o) OVER (PARTITION BY element) AS e FROM c JOIN s USING (grp))"""


@query(f"WITH {CHI} SELECT element, CASE WHEN count(*) FILTER (o > 0) = 3 THEN round(sum((o - e) * (o - e) / e), 5) END AS stat, CAST(2 AS BIGINT) AS df FROM j GROUP BY element")
def chi_square_stat(t):
    return rounded(st.chi_square(st.with_groups(t.matrix, GROUPS)), "stat", places=5)


@query(f"WITH {CHI} SELECT element, round(exp(-sum((o - e) * (o - e) / e) / 2), 6) AS p FROM j GROUP BY element HAVING count(*) FILTER (o > 0) = 3")
def chi_square_p(t):
    from lociform.functions.tails import chi_square_p as p

    got = st.chi_square(st.with_groups(t.matrix, GROUPS)).where("stat IS NOT NULL")
    return got.select("element", F.round(p("stat", "df"), 6).alias("p"))


@query(f"""WITH {MATRIX}, o AS (SELECT *, {GRP} AS grp, sum(count) OVER (PARTITION BY sample) AS t FROM matrix)
  SELECT l.element, l.grp, l.sample AS s1, r.sample AS s2, l.count AS a, r.count AS b, CAST(l.t - l.count AS BIGINT) AS rest_a, CAST(r.t - r.count AS BIGINT) AS rest_b FROM o l JOIN o r ON l.element = r.element AND l.grp = r.grp AND l.sample < r.sample""")
def within_group_pairs(t):
    return st.within_group(st.with_groups(t.matrix, GROUPS))


@query(f"""WITH {MATRIX}, o AS (SELECT *, {GRP} AS grp, sum(count) OVER (PARTITION BY sample) AS t FROM matrix), x AS (SELECT l.element, l.grp, l.sample AS s1, r.sample AS s2, l.count AS a, r.count AS b, CAST(l.t - l.count AS BIGINT) AS rest_a, CAST(r.t - r.count AS BIGINT) AS rest_b FROM o l JOIN o r ON l.element = r.element AND l.grp = r.grp AND l.sample < r.sample),
  k AS (SELECT *, unnest(range(greatest(0, a - rest_b), least(a + b, a + rest_a) + 1)) AS k FROM x), p AS (SELECT *, exp({lf('a + b')} + {lf('rest_a + rest_b')} + {lf('a + rest_a')} + {lf('b + rest_b')} - {lf('a + b + rest_a + rest_b')} - {lf('k')} - {lf('a + b - k')} - {lf('a + rest_a - k')} - {lf('rest_b - a + k')}) AS w FROM k),
  q AS (SELECT element, grp, s1, s2, least(1.0, sum(w) FILTER (w <= own * (1 + 1e-7))) AS p FROM (SELECT *, max(w) FILTER (k = a) OVER (PARTITION BY element, s1, s2) AS own FROM p) GROUP BY ALL) SELECT element, grp, round(avg(p), 5) AS mean_p, round(min(p), 5) AS min_p FROM q GROUP BY ALL""")
def within_group_variability(t):
    p = st.fisher(st.within_group(st.with_groups(t.matrix, GROUPS)))
    return p.groupBy("element", "grp").agg(F.round(F.avg("p"), 5).alias("mean_p"), F.round(F.min("p"), 5).alias("min_p"))


@query(f"""WITH {MATRIX}, o AS (SELECT element, CAST(coalesce(sum(count) FILTER ({GRP} = 'A'), 0) AS BIGINT) AS a, CAST(coalesce(sum(count) FILTER ({GRP} = 'N'), 0) AS BIGINT) AS b, CAST(coalesce(sum(count) FILTER ({GRP} = 'R'), 0) AS BIGINT) AS c FROM matrix GROUP BY element),
  x AS (SELECT *, a + b + c AS r, CAST(sum(a) OVER () AS BIGINT) AS ca, CAST(sum(b) OVER () AS BIGINT) AS cb, CAST(sum(c) OVER () AS BIGINT) AS cc, CAST(sum(a + b + c) OVER () AS BIGINT) AS n FROM o), w AS (SELECT *, CAST(15 * sqrt(r) AS BIGINT) + 20 AS reach, CAST(r * ca // n AS BIGINT) AS ma, CAST(r * cb // n AS BIGINT) AS mb FROM x),
  i AS (SELECT *, unnest(range(greatest(0, ma - reach), least(r, ca, ma + reach) + 1)) AS i FROM w), j AS (SELECT *, unnest(range(greatest(0, mb - reach), least(r - i, cb, mb + reach) + 1)) AS j FROM i),
  p AS (SELECT element, i, j, a, b, {lf('ca')} - {lf('i')} - {lf('ca - i')} + {lf('cb')} - {lf('j')} - {lf('cb - j')} + {lf('cc')} - {lf('r - i - j')} - {lf('cc - r + i + j')} - {lf('n')} + {lf('r')} + {lf('n - r')} AS l FROM j WHERE r - i - j <= cc)
  SELECT element, 'exact' AS method, round(least(1.0, sum(exp(l)) FILTER (l <= own + 1e-7)), 5) AS p FROM (SELECT *, max(l) FILTER (i = a AND j = b) OVER (PARTITION BY element) AS own FROM p) GROUP BY element""")
def fisher_r_by_c(t):
    """Each element's counts in three groups against those of all other elements, exact."""
    from lociform.functions.tails import fisher_p_table

    m = st.with_groups(t.matrix, GROUPS)
    n = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("count"))), F.lit(0))
    own = m.groupBy("element").agg(*(n(g).alias(f"n_{g}") for g in "ANR"))
    both = own.join(F.broadcast(m.agg(*(n(g).alias(f"t_{g}") for g in "ANR"))), F.lit(True))
    cells = F.array(*(F.col(f"n_{g}").cast("int") for g in "ANR"), *((F.col(f"t_{g}") - F.col(f"n_{g}")).cast("int") for g in "ANR"))
    got = both.repartition(64, "element").select("element", fisher_p_table(cells, F.lit(3)).alias("f"))
    return got.select("element", "f.method", F.round("f.p", 5).alias("p"))


PV = "pv AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN CAST('NaN' AS DOUBLE) ELSE CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007 END AS p FROM events)"
PGOOD = "pv AS (SELECT event_id, user_id, CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007 AS p FROM events)"


def pv(t: Tables, nan: bool = True):
    p = (F.col("event_id") * 7919 % 10007).cast("double") / 10007
    return t["events"].select("event_id", "user_id", (F.when(F.col("event_id") % 10 == 3, F.lit(float("nan"))).otherwise(p) if nan else p).alias("p"))


@query(f"WITH {PGOOD} SELECT event_id, round(least(1.0, p * count(*) OVER ()), 6) AS adjusted FROM pv")
def bonferroni(t):
    return rounded(st.bonferroni(pv(t, False).select("event_id", "p"), "p"), "adjusted").select("event_id", "adjusted")


def _bh_sql(source: str, ignored: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY isnan(p), CASE WHEN isnan(p) THEN 0 ELSE p END, event_id) AS r, count(*) OVER () + {ignored} AS n FROM {source}),
  a AS (SELECT *, CASE WHEN isnan(p) THEN 1.0 ELSE least(1.0, p * n / r) END AS raw FROM r), q AS (SELECT event_id, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS q FROM a)"""


@query(f"WITH {PV}, {_bh_sql('pv', 0)} SELECT event_id, round(q, 6) AS q FROM q")
def bh_fdr(t):
    return rounded(st.benjamini_hochberg(pv(t).select("event_id", "p"), "p", "event_id"), "q").select("event_id", "q")


@query(f"WITH {PGOOD}, near AS (SELECT * FROM pv WHERE p < 0.2), {_bh_sql('near', 0).replace('count(*) OVER () + 0', '(SELECT count(*) FROM pv)')} SELECT event_id, round(q, 6) AS q FROM q")
def bh_truncated(t):
    p = pv(t, False).select("event_id", "p")
    near = p.where("p < 0.2")
    return rounded(st.benjamini_hochberg(near, "p", "event_id", p.count() - near.count()), "q").select("event_id", "q")


@query(f"WITH {PGOOD}, near AS (SELECT * FROM pv WHERE p < 0.05), {_bh_sql('near', 0).replace('count(*) OVER () + 0', '(SELECT count(*) FROM pv)')} SELECT event_id, round(q, 6) AS q FROM q WHERE q <= 0.99999")
def fdr_combine(t):
    p = pv(t, False).select("event_id", "p")
    parts = [p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1")]
    return rounded(st.fdr(parts, ["p"], "event_id", 0.05, 0.99999), "q").select("event_id", "q")


@query(f"""WITH {PGOOD}, g AS (SELECT user_id, max(p) AS p_max, min(p) AS p_min, least(1.0, sum(p)) AS p_sum, list_sort(list(p)) AS l FROM pv GROUP BY user_id),
  x AS (SELECT *, CASE WHEN p_min > 0 THEN -list_sum(list_transform(l, lambda p: ln(CASE WHEN p > 0 THEN p ELSE 1 END))) END AS x, len(l) AS n FROM g),
  y AS (SELECT *, list_transform(range(n), lambda i: -x + i * ln(x) - lgamma(CAST(i AS DOUBLE) + 1)) AS terms FROM x)
  SELECT user_id, round(p_max, 6) AS p_max, round(p_min, 6) AS p_min, round(p_sum, 6) AS p_sum, round(l[n // 2 + 1], 6) AS p_median,
   round(CASE WHEN x IS NULL THEN 0.0 ELSE least(1.0, exp(list_max(terms)) * list_sum(list_transform(terms, lambda y: exp(y - list_max(terms))))) END, 6) AS p_qfast FROM y""")
def combine_p(t):
    return rounded(st.combined(pv(t, False), "user_id", "p"), "p_max", "p_min", "p_sum", "p_median", "p_qfast")


PAIRS = """pairs AS (SELECT l_partkey AS pos, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS cma, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 25) AS ca,
  count(*) FILTER (l_returnflag = 'N') AS cmb, count(*) FILTER (l_returnflag = 'R') AS cb FROM lineitem GROUP BY l_partkey)"""


def pairs(t: Tables):
    n = lambda c, a: F.sum(F.expr(c).cast("long")).alias(a)
    return t["lineitem"].groupBy(F.col("l_partkey").alias("pos")).agg(n("l_returnflag = 'A' AND l_linestatus = 'F'", "cma"), n("l_returnflag = 'A' AND l_quantity > 25", "ca"), n("l_returnflag = 'N'", "cmb"), n("l_returnflag = 'R'", "cb"))


STATS = f"""{PAIRS}, d AS (SELECT *, cma - ca AS da, cmb - cb AS db, least(cma + ca, cmb + cb) AS cov FROM pairs),
  e AS (SELECT *, CAST(CASE WHEN da * db > 0 THEN greatest(abs(da), abs(db)) ELSE abs(da) + abs(db) END AS DOUBLE) AS s34, CAST(CASE WHEN da * db > 0 THEN greatest(abs(cma - cmb), abs(ca - cb)) ELSE abs(cma - cmb) + abs(ca - cb) END AS DOUBLE) AS s5,
   CAST(floor(cov / 100) * 100 + 50 AS DOUBLE) AS mid, CAST(cma AS DOUBLE) / nullif(cma + ca, 0) AS mra, CAST(cmb AS DOUBLE) / nullif(cmb + cb, 0) AS mrb, CAST(cma + cmb AS DOUBLE) / nullif(cma + ca + cmb + cb, 0) AS pool FROM d)"""


@query(f"""WITH {STATS} SELECT pos, round(s34 / (cov + s34 + 1), 6) AS stat3, round(least(20.0, s34 / mid), 6) AS stat4, round(least(20.0, s5 / mid), 6) AS stat5, round(100 * abs(mra - mrb), 6) AS dmr,
  round(least(500.0, coalesce(abs(mra - mrb) / nullif(sqrt(pool * (1 - pool) * (1.0 / nullif(cma + ca, 0) + 1.0 / nullif(cmb + cb, 0))), 0), 0)), 6) AS ptest, CAST(least(abs(da) + abs(db), 10000) AS DOUBLE) AS delta, cov AS covariate FROM e""")
def pair_statistics(t):
    p = pairs(t)
    got = p.select("pos", *(c.alias(n) for n, c in st.pair_statistics(*(F.col(x) for x in ("cma", "ca", "cmb", "cb"))).items()))
    return rounded(got, "stat3", "stat4", "stat5", "dmr", "ptest")


EMP = f"{STATS}, s AS (SELECT pos, CAST(floor(cov / 5) AS INT) AS bin, CAST(floor(s34 / (cov + s34 + 1) * 100) AS BIGINT) AS k FROM e WHERE cma + ca > 0 AND cmb + cb > 0)"


def scored(t: Tables):
    p = pairs(t).where("cma + ca > 0 AND cmb + cb > 0")
    s = st.pair_statistics(*(F.col(x) for x in ("cma", "ca", "cmb", "cb")))
    return p.select("pos", st.bins(s["covariate"], "by5").alias("bin"), s["stat3"].alias("s"))


@query(f"WITH {EMP}, h AS (SELECT bin, k, count(*) AS n FROM s WHERE pos % 2 = 0 GROUP BY ALL) SELECT pos, round((coalesce((SELECT sum(n) FROM h WHERE h.bin = s.bin AND h.k > s.k), 0) + 1.0) / (coalesce((SELECT sum(n) FROM h WHERE h.bin = s.bin), 0) + 1), 6) AS p FROM s WHERE pos % 2 = 1")
def empirical_p(t):
    s = scored(t)
    return st.empirical(s.where("pos % 2 = 0"), s.where("pos % 2 = 1")).select("pos", F.round("p", 6).alias("p"))


@query(f"WITH {EMP}, h AS (SELECT bin, k, count(*) AS n FROM s WHERE pos % 2 = 0 GROUP BY ALL) SELECT pos, round((coalesce((SELECT sum(n) FROM h WHERE h.bin = s.bin AND h.k >= s.k), 0) + 1.0) / (coalesce((SELECT sum(n) FROM h WHERE h.bin = s.bin), 0) + 1), 6) AS p FROM s WHERE pos % 2 = 1")
def empirical_p_reaching(t):
    s = scored(t)
    return st.empirical(s.where("pos % 2 = 0"), s.where("pos % 2 = 1"), strict=False).select("pos", F.round("p", 6).alias("p"))


@query("SELECT l_partkey, n, CAST(n // 100 AS INT) AS linear, CAST(floor(log2(n)) AS INT) AS log2, CAST(floor(log10(n)) AS INT) AS log10, CAST(n // 5 AS INT) AS by5, CAST(CASE WHEN n < 100 THEN n // 10 ELSE 8 + floor(log10(n)) END AS INT) AS small_log10 FROM (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)")
def covariate_bins(t):
    own = t["lineitem"].groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    return own.select("l_partkey", "n", *(st.bins(F.col("n"), k).alias(k) for k in ("linear", "log2", "log10", "by5", "small_log10")))


@query(f"""WITH {PAIRS} SELECT pos, round(log2(CAST((cmb + 1) * (ca + 1) AS DOUBLE) / ((cma + 1) * (cb + 1))), 6) AS log2_odds, CASE WHEN least(cma, ca, cmb, cb) >= 10 THEN round(sqrt(1.0 / cmb + 1.0 / ca + 1.0 / cb + 1.0 / cma), 6) END AS error,
  CASE WHEN least(cma, ca, cmb, cb) >= 10 THEN round(log2(CAST((cmb + 1) * (ca + 1) AS DOUBLE) / ((cma + 1) * (cb + 1))) / sqrt(1.0 / cmb + 1.0 / ca + 1.0 / cb + 1.0 / cma), 6) END AS z FROM pairs""")
def group_odds_ratio(t):
    c = st.odds_ratio(F.col("cma"), F.col("ca"), F.col("cmb"), F.col("cb"))
    return rounded(pairs(t).select("pos", *(v.alias(k) for k, v in c.items())), "log2_odds", "error", "z")


SOM = f"""{PAIRS}, s AS (SELECT pos, 0 AS allele, cma AS count, ca AS failed, cma + ca + 1 AS coverage, 1000 + pos AS reads, cb % 4 AS parent_most, cb AS germline_most, cmb + cb AS relative_coverage, CAST(cb AS DOUBLE) / 60 AS relative_frequency, 2000 + pos AS relative_reads, cb AS relative_count FROM pairs)"""


@query(f"""WITH {SOM}, f AS (SELECT *, CAST(count AS DOUBLE) / coverage AS frequency FROM s) SELECT pos, round(frequency, 6) AS frequency, parent_most <= 0 AND germline_most <= 10 AS strict, round(1e8 * (CAST(count AS DOUBLE) / reads - CAST(relative_count AS DOUBLE) / relative_reads), 3) AS priority
  FROM f WHERE count > 0 AND NOT (parent_most > failed OR parent_most > 5) AND NOT (germline_most >= 10 AND germline_most >= 1.5 * failed) AND relative_coverage >= coverage / 2 AND frequency > 3 * relative_frequency""")
def somatic_candidates(t):
    c = F.col
    s = pairs(t).select("pos", c("cma").alias("count"), c("ca").alias("failed"), (c("cma") + c("ca") + 1).alias("coverage"), (1000 + c("pos")).alias("reads"), (c("cb") % 4).alias("parent_most"), c("cb").alias("germline_most"), (c("cmb") + c("cb")).alias("relative_coverage"), (c("cb") / 60).alias("relative_frequency"), (2000 + c("pos")).alias("relative_reads"), c("cb").alias("relative_count"))
    return st.somatic(s).select("pos", F.round("frequency", 6).alias("frequency"), "strict", F.round("priority", 3).alias("priority"))
