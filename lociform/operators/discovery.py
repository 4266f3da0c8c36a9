"""Variant discovery in the output formats of its program, by name.

Every format takes observations (pos, sample, grp, allele, strand, quality, read_index)
whose allele 0 is the reference, and gives rows by site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions import tails
from lociform.operators import pileup as pu
from lociform.operators import reads as rd
from lociform.operators import windows as wi

FORMATS: dict[str, Callable[..., DataFrame]] = {}


def output(name: str):
    """Registers a format; others may add theirs."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FORMATS[name] = f
        return f

    return put


def discover(obs: DataFrame, kind: str, **options) -> DataFrame:
    """The observations in a format."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}: known are {', '.join(sorted(FORMATS))}")
    return FORMATS[kind](obs, **options)


def _n(c: Column) -> Column:
    return F.sum(c.cast("long"))


def by_read_index(obs: DataFrame, by: str = "sample") -> DataFrame:
    """(read_index, by, variants, reference): bases seen at each place of a read."""
    return obs.groupBy("read_index", by).agg(_n(F.col("allele") != 0).alias("variants"), _n(F.col("allele") == 0).alias("reference"))


@output("between-groups")
def between_groups(obs: DataFrame) -> DataFrame:
    """Sites that pass the gate with each group's counts, indices and variations."""
    sites = pu.site_gate(obs, "pos", F.col("allele") != 0).select("pos")
    return pu.group_variations(obs, "pos", "grp", "allele", F.lit(0).cast("long")).join(sites, "pos", "left_semi")


@output("within-groups")
def within_groups(obs: DataFrame) -> DataFrame:
    """(pos, grp, variants, reference, expected_variants, expected_reference, p): whether a group has more variants
    at a site than the error rate of its bases' read indices explains (T16)."""
    rates = by_read_index(obs).select("read_index", "sample", F.col("variants").alias("__v"), F.col("reference").alias("__r"))
    seen = obs.join(F.broadcast(rates) if rates.limit(10_001).count() <= 10_000 else rates, ["read_index", "sample"])
    got = seen.groupBy("pos", "grp").agg(_n(F.col("allele") != 0).alias("variants"), _n(F.col("allele") == 0).alias("reference"), F.sum("__v").alias("__v"), F.sum(F.col("__v") + F.col("__r")).alias("__all"))
    n, rate = F.col("variants") + F.col("reference"), F.col("__v") / F.col("__all")
    whole = lambda x: F.floor(x + 0.5).cast("long")
    got = got.withColumns({"expected_variants": whole(rate * n), "expected_reference": whole((1 - rate) * n)})
    return got.withColumn("p", tails.fisher_p_greater("variants", "expected_variants", "reference", "expected_reference")).drop("__v", "__all")


@output("compare-groups")
def compare_groups(obs: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """(pos, variants_a, reference_a, variants_b, reference_b, log2_odds, p) of two groups."""
    cell = lambda g, variant, name: _n((F.col("grp") == g) & ((F.col("allele") != 0) == F.lit(variant))).alias(name)
    t = obs.groupBy("pos").agg(cell(a, True, "variants_a"), cell(a, False, "reference_a"), cell(b, True, "variants_b"), cell(b, False, "reference_b"))
    odds = F.log2(((F.col("variants_a") + 1) * (F.col("reference_b") + 1)) / ((F.col("reference_a") + 1) * (F.col("variants_b") + 1)))
    return t.withColumn("log2_odds", odds).withColumn("p", tails.fisher_p("variants_a", "reference_a", "variants_b", "reference_b"))


def _counts(obs: DataFrame) -> DataFrame:
    return pu.started(pu.allele_counts(obs, pu.SITE, "allele", F.col("strand") == "O"))


@output("genotypes")
def genotypes(obs: DataFrame, support: int = 1) -> DataFrame:
    return pu.genotypes(pu.leftover(_counts(obs), support), F.lit(0))


@output("allele-frequencies")
def allele_frequencies(obs: DataFrame) -> DataFrame:
    """(pos, grp, group_rp, samples): each sample's share of the reference, averaged by group."""
    each = obs.groupBy("pos", "sample", "grp").agg(F.avg((F.col("allele") == 0).cast("int")).alias("rp"))
    return each.groupBy("pos", "grp").agg(F.avg("rp").alias("group_rp"), F.count("rp").alias("samples"))


@output("methylation")
def methylation(obs: DataFrame, reference: str = "ref", base: str = "base") -> DataFrame:
    return wi.methylation(obs, ["pos", "sample", "grp"], reference, base, F.col("strand") == "O")


@output("indel-counts")
def indel_counts(obs: DataFrame, is_indel: Column | None = None, slice_size: int = 100) -> DataFrame:
    hit = F.col("allele") < 0 if is_indel is None else is_indel
    sites = obs.groupBy("pos", "sample").agg(F.count("*").alias("bases"), _n(hit).alias("indel_count"))
    return pu.indel_rate(sites, slice_size)


@output("base-information")
def base_information(obs: DataFrame) -> DataFrame:
    return rd.base_information(obs, ["quality", "read_index"])
