"""Bases by position, genotype filters and site gates.

Observations are rows (pos, sample, allele, strand, ...); allele counts are rows
(pos, sample, allele, n, forward, reverse, removed), where ``removed`` tells how many a
filter has taken so far. Filters are transforms of such tables and run in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITE = ["pos", "sample"]


def allele_counts(obs: DataFrame, keys: list[str], allele: str, forward: Column) -> DataFrame:
    """Counts by allele and strand (A17, W16): one aggregate instead of a sweep over sorted reads."""
    f = F.sum(forward.cast("long"))
    return obs.groupBy(*keys, allele).agg(F.count("*").alias("n"), f.alias("forward"), (F.count("*") - f).alias("reverse"))


def exploded(reads: DataFrame, start: str, seq: str) -> DataFrame:
    """One row for each base of a read: position, base and read index (W16, table-valued expansion of 2.11)."""
    bases = F.posexplode(F.split(seq, "")).alias("offset", "base")
    return reads.select("*", bases).where("base != ''").withColumn("pos", F.col(start) + F.col("offset")).withColumn("read_index", F.col("offset") + 1)


def started(counts: DataFrame) -> DataFrame:
    """Counts on which no filter ran yet."""
    return counts.withColumn("removed", F.lit(0).cast("long")).withColumn("original", F.col("n"))


def _drop(counts: DataFrame, gone: Column) -> DataFrame:
    keep = lambda c: F.when(gone, F.lit(0)).otherwise(F.col(c)).cast("long")
    return counts.withColumn("removed", F.when(gone, F.col("removed") + F.col("n")).otherwise(F.col("removed")).cast("long")).withColumns({c: keep(c) for c in ("n", "forward", "reverse")})


def low_quality(obs: DataFrame, quality: str, is_reference: Column, floor: int = 30, guard: Column | None = None) -> DataFrame:
    """Observations without variant bases under a quality (F18); ``guard`` (0 to 1, a hash of the row) lets those
    through whose allele's share of the site is larger."""
    low = ~is_reference & (F.col(quality) < floor)
    if guard is not None:
        share = F.count("*").over(W.partitionBy(*SITE, "allele")) / F.count("*").over(W.partitionBy(*SITE))
        return obs.withColumn("__gone", low & (guard > share)).where("NOT __gone").drop("__gone")
    return obs.where(~low)


def leftover(counts: DataFrame, support: int) -> DataFrame:
    """Removes alleles with 0 < count < 2 * (support + what earlier filters removed of the sample's site)."""
    taken = F.sum("removed").over(W.partitionBy(*SITE))
    own = counts.withColumn("__t", 2 * (support + taken))
    return _drop(own, (F.col("n") > 0) & (F.col("n") < F.col("__t"))).drop("__t")


def at_least_a_quarter(counts: DataFrame) -> DataFrame:
    """Removes alleles with 0 < count < largest count div 4."""
    own = counts.withColumn("__m", F.floor(F.max("n").over(W.partitionBy(*SITE)) / 4))
    return _drop(own, (F.col("n") > 0) & (F.col("n") < F.col("__m"))).drop("__m")


def diploid(counts: DataFrame) -> DataFrame:
    """Keeps the alleles of the two largest counts; of the largest only, if more than two have them."""
    w = W.partitionBy(*SITE)
    own = counts.withColumn("__m1", F.max("n").over(w))
    own = own.withColumn("__m2", F.max(F.when(F.col("n") < F.col("__m1"), F.col("n"))).over(w))
    many = F.sum(F.col("n").isin(F.col("__m1"), F.col("__m2")).cast("int")).over(w) > 2
    own = own.withColumn("__m2", F.when(many, -1).otherwise(F.coalesce("__m2", F.lit(-1))))
    return _drop(own, (F.col("n") != F.col("__m1")) & (F.col("n") != F.col("__m2"))).drop("__m1", "__m2")


def strand_bias(counts: DataFrame, least: int) -> DataFrame:
    """Removes alleles that reach least + 1 on one strand only."""
    return _drop(counts, (F.col("n") >= least + 1) & ((F.col("forward") == 0) | (F.col("reverse") == 0)))


def inside_indels(counts: DataFrame, indels: DataFrame) -> DataFrame:
    """Removes bases at positions that an indel of the same sample deletes (F23); indels: (pos, sample, length)."""
    gone = indels.select(F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("length"))).alias("pos"), "sample").distinct().withColumn("__gone", F.lit(True))
    own = counts.join(gone, SITE, "left")
    return _drop(own, F.coalesce("__gone", F.lit(False))).drop("__gone")


def common_indels(indels: DataFrame, cdf) -> DataFrame:
    """Indels seen more often than their repeat predicts (F23; Q3: fractions are doubles).

    indels: (observed, predicted) counts; ``cdf`` is the Poisson distribution function.
    """
    return indels.where((F.col("observed") > F.col("predicted")) & (cdf(F.col("predicted"), F.col("observed")) <= 0.05))


def entropic_indels(indels: DataFrame, most: int) -> DataFrame:
    """Indels of sites with at most ``most`` different indels; forward and reverse counts add up (F23; Q2)."""
    w = W.partitionBy(*SITE)
    return indels.withColumn("n", F.col("forward") + F.col("reverse")).withColumn("__k", F.size(F.collect_set("indel").over(w))).where(F.col("__k") <= most).drop("__k")


def site_gate(obs: DataFrame, site: str, is_variant: Column, indices: int = 3, support: int = 10) -> DataFrame:
    """Sites with at least ``indices`` distinct read indices and more than ``support`` variant bases (F25; Q14)."""
    v = obs.where(is_variant).groupBy(site).agg(F.count_distinct("read_index").alias("distinct_indices"), F.count("*").alias("variants"))
    return v.where((F.col("distinct_indices") >= indices) & (F.col("variants") > support))


def group_variations(obs: DataFrame, site: str, group: str, allele: str, reference: Column) -> DataFrame:
    """By site and group: reference and variant counts, distinct read indices, and "n:ref/allele" by falling n."""
    by = obs.withColumn("__ref", reference)
    each = by.groupBy(site, group, "__ref", allele).agg(F.count("*").alias("__n"), F.collect_set("read_index").alias("__idx"))
    v = F.col(allele) != F.col("__ref")
    text = F.concat_ws("", F.col("__n").cast("string"), F.lit(":"), F.col("__ref").cast("string"), F.lit("/"), F.col(allele).cast("string"))
    seen = F.array_sort(F.collect_list(F.when(v, F.struct((-F.col("__n")).alias("k"), F.col(allele).alias("a"), text.alias("t")))))
    count = lambda c: F.sum(F.when(c, F.col("__n")).otherwise(0))
    return each.groupBy(site, group).agg(count(~v).alias("ref_count"), count(v).alias("var_count"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(v, F.col("__idx")))))).alias("distinct_read_indices"), F.array_join(F.transform(seen, lambda x: x["t"]), ",").alias("variations"))


def zygosity(alleles: Column) -> Column:
    """Label from the array of alleles called."""
    n = F.size(F.array_distinct(alleles))
    return F.when(n == 0, "not-typed").when(n == 1, "homozygous").when(n == 2, "heterozygous").otherwise("Mixture")


def genotypes(counts: DataFrame, reference: Column) -> DataFrame:
    """(pos, sample, genotype, alleles, zygosity, n_good, n_failed) of filtered counts (C17, C18, T25 genotypes)."""
    called = counts.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("allele")))).alias("alleles"), F.sum("n").alias("n_good"), F.sum("removed").alias("n_failed"), F.first(reference).alias("reference"))
    name = F.array_join(F.transform("alleles", lambda a: a.cast("string")), "/")
    return called.select(*SITE, F.when(F.size("alleles") == 0, "./.").when(F.size("alleles") == 1, F.concat_ws("/", name, name)).otherwise(name).alias("genotype"), zygosity(F.col("alleles")).alias("zygosity"), "n_good", "n_failed")


def allele_frequency(counts: DataFrame, reference: Column, group: Column) -> DataFrame:
    """Reference proportion by sample, its mean by group."""
    each = counts.groupBy(*SITE).agg((F.sum(F.when(reference, F.col("n")).otherwise(0)) / F.sum("n")).alias("rp"))
    return each.withColumn("grp", group).groupBy("pos", "grp").agg(F.avg("rp").alias("group_rp"), F.count("rp").alias("samples"))


def indel_rate(sites: DataFrame, slice_size: int) -> DataFrame:
    """Indels per 100 000 observed sites by slice and sample (A22); sites: (pos, sample, bases, indel_count)."""
    seen, hit = F.col("bases") >= 5, (F.col("bases") >= 5) & (F.col("indel_count") >= F.greatest(F.lit(5.0), F.col("bases") / 3))
    own = sites.groupBy(F.floor(F.col("pos") / slice_size).alias("slice"), "sample").agg(F.sum(hit.cast("long")).alias("indels"), F.sum(seen.cast("long")).alias("sites"))
    return own.withColumn("rate", F.when(F.col("sites") > 0, 100000 * F.col("indels") / F.col("sites")))
