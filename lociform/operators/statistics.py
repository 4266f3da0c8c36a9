"""Normalisation, fold changes, tests, adjustment and combination of p-values, empirical p-values.

Expression tables are long: (element, sample, count, length).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.functions import tails


def groups_of(definition: str) -> dict[str, list[str]]:
    """"A=s1,s2/B=s3" as samples by group."""
    return {g.strip(): [s.strip() for s in members.split(",")] for g, _, members in (part.partition("=") for part in definition.split("/"))}


def comparisons_of(definition: str) -> list[tuple[str, str]]:
    """"A/B,A/C" as pairs of groups."""
    return [(a.strip(), b.strip()) for a, _, b in (part.partition("/") for part in definition.split(","))]


def with_groups(df: DataFrame, definition: str, sample: str = "sample") -> DataFrame:
    """``df`` with the group of each sample; samples without a group are left out."""
    group = F.lit(None).cast("string")
    for name, members in groups_of(definition).items():
        group = F.when(F.col(sample).isin(members), name).otherwise(group)
    return df.withColumn("grp", group).where("grp IS NOT NULL")


def aligned_totals(counts: DataFrame) -> DataFrame:
    """(sample, total): the aligned-count denominator."""
    return counts.groupBy("sample").agg(F.sum("count").alias("total"))


def upper_quartiles(counts: DataFrame) -> DataFrame:
    """(sample, denominator): sorted counts at index int(0.75 n) over elements with a count in any sample,
    brought to the scale of the totals, at least 1 (T3; no interpolation)."""
    live = counts.groupBy("element").agg(F.sum("count").alias("__all")).where(F.col("__all") > 0).select("element")
    seen = counts.join(live, "element").where(F.col("count") > 0)
    w = W.partitionBy("sample")
    # elements without a count in a sample stand before all others and need no rows
    n = live.agg(F.count("*").alias("__n"))
    ranked = seen.withColumn("__r", F.row_number().over(w.orderBy("count", "element"))).withColumn("__m", F.count("*").over(w)).join(F.broadcast(n), F.lit(True))
    at = F.floor(F.col("__n") * 0.75) - (F.col("__n") - F.col("__m")) + 1
    q = ranked.groupBy("sample").agg(F.coalesce(F.max(F.when(F.col("__r") == at, F.col("count"))), F.lit(0)).alias("q"), F.sum("count").alias("total"))
    ratio = F.sum("total").over(W.partitionBy(F.lit(0))) / F.sum("q").over(W.partitionBy(F.lit(0)))
    return q.select("sample", F.greatest(F.lit(1.0), F.col("q") * ratio).alias("denominator"))


def rpkm(count: Column, length: Column, total: Column, plus_one: bool = False) -> Column:
    """Reads per kilobase and million (C10; Q13: differential expression adds 1 to the count)."""
    return (count + int(plus_one)) / (length / 1000) / (total / 1e6)


NORMALIZATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "aligned-count": lambda c: aligned_totals(c).select("sample", F.col("total").cast("double").alias("denominator")),
    "bullard-upper-quartile": upper_quartiles,
}


def normalized(counts: DataFrame, method: str = "aligned-count") -> DataFrame:
    """counts with ``value``, the normalised count by a registered method (2.11 normalisation)."""
    return counts.join(NORMALIZATIONS[method](counts), "sample").withColumn("value", rpkm(F.col("count"), F.col("length"), F.col("denominator"), True))


def group_averages(values: DataFrame) -> DataFrame:
    """(element, grp, average, samples) of (element, grp, value) (T5)."""
    return values.groupBy("element", "grp").agg(F.avg("value").alias("average"), F.count("*").alias("samples"))


def fold_changes(averages: DataFrame, a: str, b: str) -> DataFrame:
    """(element, fold, magnitude, log2_fold) of group a over group b."""
    pick = lambda g: F.max(F.when(F.col("grp") == g, F.col("average")))
    both = averages.groupBy("element").agg(pick(a).alias("a"), pick(b).alias("b"))
    shifted = (F.col("a") + 1e-6) / (F.col("b") + 1e-6)
    return both.select("element", (F.col("a") / F.nullif("b", F.lit(0.0))).alias("fold"), F.greatest(shifted, 1 / shifted).alias("magnitude"), (F.log2("a") - F.log2("b")).alias("log2_fold"))


def t_tests(values: DataFrame, a: str, b: str) -> DataFrame:
    """(element, t_pooled, df_pooled, t_welch, df_welch) of log1p values; null below two samples a group (T7; Q15: both)."""
    v = F.log1p("value")
    pick = lambda f, g: f(F.when(F.col("grp") == g, v))
    m = values.groupBy("element").agg(*(pick(f, g).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))).where("n0 > 1 AND n1 > 1")
    d, df = F.col("m0") - F.col("m1"), F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / df
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    some = lambda x: F.nullif(x, F.lit(0.0))
    return m.select("element", (d / some(F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1"))))).alias("t_pooled"), df.cast("double").alias("df_pooled"), (d / some(F.sqrt(s0 + s1))).alias("t_welch"), ((s0 + s1) ** 2 / some(s0**2 / (F.col("n0") - 1) + s1**2 / (F.col("n1") - 1))).alias("df_welch"))


def t_test_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_pooled", tails.t_p("t_pooled", "df_pooled")).withColumn("p_welch", tails.t_p("t_welch", "df_welch"))


def two_by_two(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(element, a, b, rest_a, rest_b): group sums of each element against the rest of the group."""
    own = counts.groupBy("element").agg(*(F.sum(F.when(F.col("grp") == g, F.col("count")).otherwise(0)).alias(n) for g, n in ((a, "a"), (b, "b"))))
    return _with_totals(own, all_a=F.sum("a"), all_b=F.sum("b")).select("element", "a", "b", (F.col("all_a") - F.col("a")).alias("rest_a"), (F.col("all_b") - F.col("b")).alias("rest_b"))


def _with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates over all its rows, which are one row."""
    return df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in totals.items()))), F.lit(True))


def fisher(tables: DataFrame) -> DataFrame:
    return tables.withColumn("p", tails.fisher_p("a", "b", "rest_a", "rest_b"))


def chi_square(counts: DataFrame) -> DataFrame:
    """(element, stat, df): group sums against the groups' shares of all counts; null where a group has none."""
    share = counts.groupBy("grp").agg(F.sum("count").alias("g")).select("grp", (F.col("g") / F.sum("g").over(W.partitionBy(F.lit(0)))).alias("share"))
    own = counts.groupBy("element", "grp").agg(F.sum("count").alias("o"))
    n = F.sum("o").over(W.partitionBy("element"))
    joined = own.withColumn("n", n).join(share, "grp")
    k = share.agg(F.count("*").alias("k"))
    each = joined.groupBy("element").agg(F.sum((F.col("o") - F.col("share") * F.col("n")) ** 2 / (F.col("share") * F.col("n"))).alias("s"), F.count(F.when(F.col("o") > 0, 1)).alias("groups"))
    return each.join(F.broadcast(k), F.lit(True)).select("element", F.when(F.col("groups") == F.col("k"), F.col("s")).alias("stat"), (F.col("k") - 1).alias("df"))


def within_group(counts: DataFrame) -> DataFrame:
    """(element, grp, s1, s2, a, b, rest_a, rest_b) for each pair of samples of a group."""
    total = counts.groupBy("sample").agg(F.sum("count").alias("t"))
    own = counts.join(total, "sample").select("element", "grp", "sample", "count", "t")
    l, r = own.alias("l"), own.alias("r")
    both = l.join(r, (F.col("l.element") == F.col("r.element")) & (F.col("l.grp") == F.col("r.grp")) & (F.col("l.sample") < F.col("r.sample")))
    return both.select("l.element", "l.grp", F.col("l.sample").alias("s1"), F.col("r.sample").alias("s2"), F.col("l.count").alias("a"), F.col("r.count").alias("b"), (F.col("l.t") - F.col("l.count")).alias("rest_a"), (F.col("r.t") - F.col("r.count")).alias("rest_b"))


def bonferroni(df: DataFrame, p: str, ignored: int = 0) -> DataFrame:
    """``df`` with ``adjusted`` = min(1, p * tests); null and NaN p count as no test."""
    counted = _with_totals(df, __n=F.count(F.when(~F.isnan(p), F.col(p))))
    return counted.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * (F.col("__n") + ignored))).drop("__n")


#: Intervals of p that adjustment deals rows to; each is a task of its own.
P_BINS = 1024


def benjamini_hochberg(df: DataFrame, p: str, key: str, ignored: int = 0) -> DataFrame:
    """``df`` with ``q`` (T13, W20): p * n / rank, running least from the largest p down, at most 1.

    NaN and null p get 1 and rank last, so n counts them, with ``ignored`` rows left out
    before. Equal p have the q of the last of them, whatever ``key`` says, so the work is on
    distinct values: counts of the bins below and sums inside give ranks, and the running
    least is taken over bins and inside. No task orders all values, and p of 1, NaN and
    null, of which there may be very many, meet no join.
    """
    live = F.coalesce(~F.isnan(p) & (F.col(p) < 1), F.lit(False))
    value = F.col(p).cast("double")
    every = df.agg((F.count("*") + ignored).alias("__all"))  # one row
    own = df.where(live).groupBy(value.alias("__p")).agg(F.count("*").alias("__n"))
    own = own.withColumn("__bin", F.least(F.floor(F.sqrt("__p") * P_BINS), F.lit(P_BINS - 1)).cast("int"))
    sizes = own.groupBy("__bin").agg(F.sum("__n").alias("__s"))
    w = W.partitionBy(F.lit(0)).orderBy("__bin")  # one row for each bin
    sizes = sizes.select("__bin", F.coalesce(F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__n").over(W.partitionBy("__bin").orderBy("__p").rowsBetween(W.unboundedPreceding, 0))
    ranked = own.withColumn("__r", inside).join(sizes, "__bin").join(F.broadcast(every), F.lit(True))
    ranked = ranked.withColumn("__q", F.least(F.lit(1.0), F.col("__p") * F.col("__all") / (F.col("__before") + F.col("__r"))))
    least = ranked.groupBy("__bin").agg(F.min("__q").alias("__m"))
    above = W.partitionBy(F.lit(0)).orderBy(F.col("__bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    least = least.select("__bin", F.coalesce(F.min("__m").over(above), F.lit(1.0)).alias("__above"))
    down = W.partitionBy("__bin").orderBy(F.col("__p").desc()).rowsBetween(W.unboundedPreceding, 0)
    values = ranked.withColumn("__q", F.min("__q").over(down)).join(least, "__bin").select("__p", F.least("__q", "__above").alias("q"))
    found = df.where(live).join(values, value == F.col("__p")).select(*df.columns, "q")
    return found.unionByName(df.where(~live).select("*", F.lit(1.0).alias("q")))


def fdr(parts: list[DataFrame], ps: list[str], key: str, prefilter: float, keep: float, top: int | None = None) -> DataFrame:
    """Parts put together; rows with any p below ``prefilter`` are adjusted by the first p, the others count as tests; q <= keep stays."""
    from lociform.operators.sets import schema_union

    every = schema_union(parts)
    some = F.lit(False)
    for p in ps:
        some = some | F.coalesce(F.col(p) < prefilter, F.lit(False))
    near = every.where(some) if ps else every
    ignored = (every.agg(F.sum((~some).cast("long"))).first()[0] or 0) if ps else 0
    got = benjamini_hochberg(near, ps[0], key, ignored).where(F.col("q") <= keep)
    return got if top is None else got.orderBy("q", ps[0], key).limit(top)


def odds_ratio(ref1: Column, var1: Column, ref2: Column, var2: Column) -> dict[str, Column]:
    """log2 odds ratio with pseudo-counts, its error (null with a cell under 10) and Z (T15; Q1: both groups)."""
    log_or = F.log2((ref2 + 1) * (var1 + 1) / ((ref1 + 1) * (var2 + 1)))
    se = F.when(F.least(ref1, var1, ref2, var2) >= 10, F.sqrt(1 / ref2 + 1 / var1 + 1 / var2 + 1 / ref1))
    return {"log2_odds": log_or, "error": se, "z": log_or / se}


def combined(df: DataFrame, key: str, p: str) -> DataFrame:
    """p-values of a key combined: largest, least, upper median, capped sum, product (T20; Q18)."""
    got = df.groupBy(key).agg(F.max(p).alias("p_max"), F.min(p).alias("p_min"), F.least(F.lit(1.0), F.sum(p)).alias("p_sum"), F.sort_array(F.collect_list(p)).alias("__p"))
    return got.withColumn("p_median", F.element_at("__p", F.floor(F.size("__p") / 2).cast("int") + 1)).withColumn("p_qfast", tails.qfast_p("__p")).drop("__p")


def pair_statistics(cma: Column, ca: Column, cmb: Column, cb: Column, covariate: str = "min") -> dict[str, Column]:
    """The pair statistics of T17 on methylated and other counts of two samples (Q25: ``covariate`` min or total)."""
    da, db = cma - ca, cmb - cb
    cov = F.least(cma + ca, cmb + cb) if covariate == "min" else cma + ca + cmb + cb
    same = da * db > 0
    s34 = F.when(same, F.greatest(F.abs(da), F.abs(db))).otherwise(F.abs(da) + F.abs(db)).cast("double")
    dm, dc = F.abs(cma - cmb), F.abs(ca - cb)
    s5 = F.when(same, F.greatest(dm, dc)).otherwise(dm + dc).cast("double")
    mid = bin_midpoint(cov)
    mra, mrb = cma / F.nullif(cma + ca, F.lit(0)), cmb / F.nullif(cmb + cb, F.lit(0))
    pool = (cma + cmb) / F.nullif(cma + ca + cmb + cb, F.lit(0))
    z = F.abs(mra - mrb) / F.nullif(F.sqrt(pool * (1 - pool) * (1 / F.nullif(cma + ca, F.lit(0)) + 1 / F.nullif(cmb + cb, F.lit(0)))), F.lit(0.0))
    return {
        "stat3": s34 / (cov + s34 + 1), "stat4": F.least(F.lit(20.0), s34 / mid), "stat5": F.least(F.lit(20.0), s5 / mid), "dmr": 100 * F.abs(mra - mrb),
        "ptest": F.least(F.lit(500.0), F.coalesce(z, F.lit(0.0))), "delta": F.least(F.abs(da) + F.abs(db), F.lit(10000)).cast("double"), "covariate": cov,
    }


def bins(x: Column, kind: str, width: int = 100) -> Column:
    """Index of the bin of a covariate."""
    log = lambda f: F.greatest(F.lit(0), F.floor(f(F.greatest(x, F.lit(1)).cast("double")))).cast("int")
    return {
        "linear": F.floor(x / width).cast("int"), "log2": log(F.log2), "log10": log(F.log10), "by5": F.floor(x / 5).cast("int"), "one": F.lit(0),
        "small_log10": F.when(x < 100, F.floor(x / 10).cast("int")).otherwise(8 + log(F.log10)),
    }[kind]


def bin_midpoint(x: Column, width: int = 100) -> Column:
    return (F.floor(x / width) * width + width / 2).cast("double")


def empirical(null: DataFrame, observed: DataFrame, scale: int = 100, strict: bool = True) -> DataFrame:
    """observed (key.., bin, s) with ``p`` = (r + 1) / (n + 1), r the null statistics of the bin above s (T18; Q17: strict by default).

    Statistics become whole numbers of 1/scale. Sums are over the distinct values of a bin,
    and each observed row looks its own up.
    """
    k = F.floor(F.col("s") * scale).cast("long")
    hist = null.groupBy("bin", k.alias("k")).agg(F.count("*").alias("n"))
    asked = observed.select("bin", k.alias("k")).distinct().withColumn("n", F.lit(0).cast("long"))
    values = hist.unionByName(asked).groupBy("bin", "k").agg(F.sum("n").alias("n"))
    down = W.partitionBy("bin").orderBy(F.col("k").desc())
    above = F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1 if strict else 0)), F.lit(0))
    p = (above + 1) / (F.sum("n").over(W.partitionBy("bin")) + 1)
    table = values.select(F.col("bin").alias("__bin"), F.col("k").alias("__k"), p.alias("p"))
    return observed.join(table, F.col("bin").eqNullSafe(F.col("__bin")) & k.eqNullSafe(F.col("__k"))).select(*observed.columns, "p")


def empirical_fdr(null_above: Column, test_above: Column) -> Column:
    """1 - (y + 1) / (r + y + 1) with y test and r null statistics above."""
    return 1 - (test_above + 1) / (null_above + test_above + 1)


def somatic(sites: DataFrame) -> DataFrame:
    """Candidate somatic alleles, frequency and priority.

    sites: (pos, allele, count, failed, coverage, reads, parent_most, germline_most, relative_coverage, relative_frequency, relative_reads, relative_count).
    """
    freq = F.col("count") / F.col("coverage")
    ok = (F.col("count") > 0) & ~((F.col("parent_most") > F.col("failed")) | (F.col("parent_most") > 5)) & ~((F.col("germline_most") >= 10) & (F.col("germline_most") >= 1.5 * F.col("failed")))
    ok = ok & (F.col("relative_coverage") >= F.col("coverage") / 2) & (freq > 3 * F.col("relative_frequency"))
    strict = ok & (F.col("parent_most") <= 0) & (F.col("germline_most") <= 10)
    priority = 1e8 * (F.col("count") / F.col("reads") - F.col("relative_count") / F.col("relative_reads"))
    return sites.withColumns({"frequency": freq, "candidate": ok, "strict": strict, "priority": priority}).where("candidate")


def observation_lines(df: DataFrame) -> DataFrame:
    """(value): observations of pairs as tab-separated lines, nulls as empty cells."""
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def top_elements(df: DataFrame, statistic: str, index: str, n: int, falling: bool = True) -> DataFrame:
    """The n first elements by a statistic, nulls last, then by index, with their ``place`` from 1."""
    by = F.col(statistic).desc_nulls_last() if falling else F.col(statistic).asc_nulls_last()
    first = df.orderBy(by, F.col(index)).limit(n)
    return first.withColumn("place", F.row_number().over(W.orderBy(by, F.col(index))))  # n rows


def tally_bases(counts: DataFrame, keys: list[str], least: int = 30, cutoff: float = 0.0) -> DataFrame:
    """``counts`` (keys, a, b) with the log fold change of sites that reach ``least`` and the cutoff.

    The change is of shares: totals are those of all rows.
    """
    totals = counts.agg(F.sum("a").alias("__sa"), F.sum("b").alias("__sb"))  # one row
    fold = F.log1p("a") - F.log1p("b") - F.log("__sa") + F.log("__sb")
    got = counts.join(F.broadcast(totals), F.lit(True)).where(F.col("a") + F.col("b") >= least).withColumn("fold", fold)
    return got.where(F.abs("fold") >= cutoff).select(*keys, "a", "b", "fold")


def offset_differences(a: DataFrame, b: DataFrame, keys: list[str], reach: int = 10) -> DataFrame:
    """(offset, difference): the summed differences of two step functions over all their segments, with the second
    moved by each offset from -reach to reach (T29)."""
    from lociform.operators.coverage import step_union

    each = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")
    still, moved = a.select("*", each), b.select("*", each).withColumn("start", F.col("start") + F.col("offset"))
    both = step_union({"a": still, "b": moved}, ["offset", *keys])
    return both.groupBy("offset").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("difference"))


#: Statistics of compared groups by name: values (element, sample, grp, count, value) and two groups in, one row for each element out.
STATISTICS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "fold-change": lambda v, a, b: fold_changes(group_averages(v), a, b),
    "t-test": lambda v, a, b: t_test_p(t_tests(v, a, b)),
    "fisher": lambda v, a, b: fisher(two_by_two(v, a, b)),
    "chi-square": lambda v, a, b: chi_square(v),
}


def evaluated(values: DataFrame, names: list[str], a: str, b: str) -> DataFrame:
    """The registered statistics side by side, columns named ``statistic.column``."""
    out = values.select("element").distinct()
    for name in names:
        got = STATISTICS[name](values, a, b)
        out = out.join(got.select("element", *(F.col(c).alias(f"{name}.{c}") for c in got.columns if c != "element")), "element", "left")
    return out
