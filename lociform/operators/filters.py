"""Row filters, best-hit selection, sampling and trimming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    """Transforms in order (F11, F24, entry processors of 2.11); the order matters to F19."""
    for step in steps:
        df = step(df)
    return df


def in_range(df: DataFrame, target: str, pos: str, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Rows from (target, position) ``start`` to ``end``, both included.

    The bounds on the target alone are stated too, so that a scan can prune by them.
    """
    key = F.struct(F.col(target).cast("long").alias("t"), F.col(pos).cast("long").alias("p"))
    bound = lambda x: F.struct(F.lit(x[0]).cast("long").alias("t"), F.lit(x[1]).cast("long").alias("p"))
    return df.where(F.col(target).between(start[0], end[0])).where((key >= bound(start)) & (key <= bound(end)))


def with_flap(df: DataFrame, start: str, low: int, high: int, flap: int) -> DataFrame:
    """Rows of a window and of the ``flap`` before it, told apart by ``emit``."""
    return df.where(F.col(start).between(low - flap, high)).withColumn("emit", F.col(start) >= low)


def named(df: DataFrame, column: str, names: str) -> DataFrame:
    """Rows whose value is in a comma-separated list (F2)."""
    return df.where(F.col(column).cast("string").isin([n.strip() for n in names.split(",")]))


def without_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def listed(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def ambiguous(df: DataFrame, hits: DataFrame, key: str, k: int, aligner_threshold: int) -> DataFrame:
    """``df`` with ``is_ambiguous`` at k locations (F5b): unlisted keys are not; at or above the aligner's threshold all listed are."""
    known = hits.groupBy(key).agg(F.max("hits").alias("__hits"))
    test = F.lit(True) if k >= aligner_threshold else F.col("__hits") >= k
    return df.join(known, key, "left").withColumn("is_ambiguous", F.coalesce(F.col("__hits").isNotNull() & test, F.lit(False))).drop("__hits")


def merge_hits(hits: DataFrame, key: str, ignored_length: int = 1) -> DataFrame:
    """Hit counts of several inputs: of the longest match, summed over the inputs that reach it."""
    own = hits.where(F.col("match_length") != ignored_length)
    top = F.max("match_length").over(W.partitionBy(key))
    return own.withColumn("__top", top).where("match_length = __top").groupBy(key).agg(F.first("match_length").alias("match_length"), F.sum("hits").alias("hits"))


def best_score(df: DataFrame, query: str, score: str, k: int | None = None) -> DataFrame:
    """Rows with the best score of their query (F6; Q9: null is no score), only where at most k share it."""
    w = W.partitionBy(query)
    best = df.withColumn("__best", F.max(score).over(w)).where(F.col(score) == F.col("__best"))
    if k is not None:
        best = best.withColumn("__n", F.count("*").over(w)).where(F.col("__n") <= k).drop("__n")
    return best.drop("__best")


def few_genes(df: DataFrame, genes: DataFrame, query: str, target: str, gene: str, k: int) -> DataFrame:
    """Rows of queries that hit at most k different genes (F8, F9 with ``best_score`` before, J13)."""
    seen = df.select(query, target).distinct().join(genes.select(target, gene), target)
    ok = seen.groupBy(query).agg(F.count_distinct(gene).alias("__n")).where(F.col("__n") <= k)
    return df.join(ok.select(query), query, "left_semi")


def few_mismatches(df: DataFrame, mismatches: str, indels: str, length: str, share: float = 0.05) -> DataFrame:
    """Rows with mismatches + indels <= round(length * share)."""
    return df.where(F.col(mismatches) + F.col(indels) <= F.floor(F.col(length) * share + 0.5))


def sampled(df: DataFrame, key: Column, rate: float, seed: int) -> DataFrame:
    """A share of the rows by a hash of their key, the same on every run."""
    # remainders first: the product of a large key would overflow
    return df.where(F.pmod(F.pmod(key, F.lit(10007)) * 7919 + seed % 10007, F.lit(10007)) < int(rate * 10007))


def capped(df: DataFrame, site: list[str], n: int, order: list[Column]) -> DataFrame:
    """At most n rows of each site, those first in ``order``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*site).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def reformatted(reads: DataFrame, seq: str, quality: str | None = None, min_length: int = 0, max_length: int | None = None, trim_start: int = 0, trim_length: int | None = None) -> DataFrame:
    """Reads of a length range, cut to a part of their bases (F16)."""
    n = F.length(seq)
    kept = reads.where(n.between(min_length, max_length) if max_length is not None else n >= min_length)
    cut = lambda c: F.substring(c, trim_start + 1, trim_length if trim_length is not None else 1 << 30)
    return kept.withColumns({c: cut(c) for c in (seq, quality) if c})


def trimmed(seq: Column, adapters: Sequence[str], min_left: int, min_right: int) -> Column:
    """A read without its adapter (F15; Q24: minima are matched lengths).

    A read inside of an adapter becomes empty. Else the longest adapter prefix of at least
    ``min_left`` that it starts with is cut, and the longest adapter suffix of at least
    ``min_right`` that it ends with.
    """
    def longest(parts: list[str], ends: bool) -> Column:
        out = F.lit(0)
        for p in sorted(set(parts), key=len):
            out = F.when(seq.endswith(p) if ends else seq.startswith(p), len(p)).otherwise(out)
        return out

    left = longest([a[:n] for a in adapters for n in range(min_left, len(a) + 1)], False)
    right = longest([a[-n:] for a in adapters for n in range(min_right, len(a) + 1)], True)
    inside = F.lit(False)
    for a in adapters:
        inside = inside | F.contains(F.lit(a), seq)
    whole = F.when(inside, F.lit(""))
    kept = F.length(seq) - left - right
    return F.coalesce(whole, F.when(kept > 0, seq.substr(left + 1, kept)).otherwise(""))


def without_lines(lines: DataFrame, column: str, pattern: str) -> DataFrame:
    """Lines that a pattern doesn't match."""
    return lines.where(~F.col(column).rlike(pattern))


def informative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` without those of ``columns`` that are 0, null or NaN in every row."""
    some = df.agg(*(F.max(F.coalesce((F.col(c) != 0) & ~F.isnan(F.col(c).cast("double")), F.lit(False))).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not some[c]))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length."""
    split = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(split(a), split(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def barcodes(reads: DataFrame, seq: str, codes: Sequence[str], allowed: int, at_end: bool = False) -> DataFrame:
    """``reads`` with ``barcode`` (index), ``mismatches``, ``ambiguous`` and the sequence without its code.

    The fewest mismatches win; none if more than ``allowed``; ambiguous if two codes tie.
    The codes are a short list of literals.
    """
    def part(c: str) -> Column:
        return F.right(seq, F.lit(len(c))) if at_end else F.substring(seq, 1, len(c))

    found = F.array_sort(F.array(*(F.struct(F.when(F.length(seq) >= len(c), hamming(part(c), F.lit(c))).otherwise(1 << 20).alias("mismatches"), F.lit(i).alias("barcode"), F.lit(len(c)).alias("size")) for i, c in enumerate(codes))))
    out = reads.withColumn("__f", found)
    best = F.col("__f")[0]
    ok = best["mismatches"] <= allowed
    tie = F.size(F.filter("__f", lambda x: x["mismatches"] == best["mismatches"])) > 1
    rest = F.col(seq).substr(F.lit(1), F.length(seq) - best["size"]) if at_end else F.col(seq).substr(best["size"] + 1, F.length(seq))
    return out.select(*reads.columns, F.when(ok & ~tie, best["barcode"]).alias("barcode"), F.when(ok, best["mismatches"]).alias("mismatches"), (ok & tie).alias("ambiguous"), F.when(ok & ~tie, rest).otherwise(F.col(seq)).alias("rest"))


def with_covariate(samples: DataFrame, column: str, value: str, exact: bool = True) -> DataFrame:
    """Samples whose bar-separated attribute has a value, or contains it as text (F32)."""
    return samples.where(F.array_contains(F.split(column, r"\|"), value) if exact else F.contains(F.col(column), F.lit(value)))


def top_unique(df: DataFrame, group: list[str], unique: str, score: str, k: int) -> DataFrame:
    """The k best rows of a group, one for each value of ``unique``."""
    one = df.withColumn("__r", F.row_number().over(W.partitionBy(*group, unique).orderBy(F.col(score).desc(), *(F.col(c) for c in df.columns)))).where("__r = 1").drop("__r")
    return one.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(unique)))).where(F.col("rank") <= k)


def counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(name, n): rows for which each named condition is true, in one pass."""
    one = df.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(conditions.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(conditions)))).alias("x")).select("x.*")
