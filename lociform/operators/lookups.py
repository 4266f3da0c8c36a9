"""Known variants, pileup views, element pairs, simulated reads, external commands and model hooks."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_map(calls: DataFrame, keys: Sequence[str], allele: str) -> DataFrame:
    """(keys, alleles): the sorted distinct alleles of each position; null alleles are left out."""
    return calls.groupBy(*keys).agg(F.array_sort(F.collect_set(allele)).alias("alleles"))


def indel_positions(calls: DataFrame, keys: Sequence[str], ref: str, alts: Column) -> DataFrame:
    """Distinct positions with an alternate whose length differs from the reference (T32); ``alts`` is an array."""
    return calls.where(F.exists(alts, lambda a: F.length(a) != F.length(ref))).select(*keys).distinct()


def with_known(df: DataFrame, known: DataFrame, keys: Sequence[str], name: str = "known") -> DataFrame:
    """``df`` with a flag for the rows whose position ``known`` holds; null positions are unknown."""
    own = known.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(own, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pileup_view(reads: DataFrame, start: str, seq: str, low: int, high: int) -> DataFrame:
    """Reads that reach into [low, high) with ``line``, their bases in the region's columns and blanks elsewhere."""
    skipped = F.greatest(F.lit(low) - F.col(start), F.lit(0)).cast("int")
    lead = F.greatest(F.col(start) - low, F.lit(0)).cast("int")
    inside = reads.where((F.col(start) < high) & (F.col(start) + F.length(seq) > low))
    bases = F.col(seq).substr(skipped + 1, F.length(seq))
    return inside.withColumn("line", F.rpad(F.concat(F.repeat(F.lit(" "), lead), bases), high - low, " "))


def pair_differences(values: DataFrame, pairs: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """(a, b, log2_difference) of listed pairs whose values both reach ``least``."""
    side = lambda s: values.where(F.col(value) >= least).select(F.col(key).alias(s), F.col(value).alias(f"__{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.log2("__a") - F.log2("__b")).alias("log2_difference"))


def _draw(*parts: Column | str) -> Column:
    """A number in [0, 1) by a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 20)


def bisulfite_reads(reads: DataFrame, seq: str, pos: str, methylated: float, seed: int) -> DataFrame:
    """Reads whose C become T unless the genome's position is methylated, which a hash of it decides."""
    each = F.transform(F.split(seq, ""), lambda b, i: F.when((b == "C") & (_draw(F.col(pos) + i, F.lit(seed)) >= methylated), "T").otherwise(b))
    return reads.withColumn(seq, F.array_join(each, ""))


def planted_indels(sequences: DataFrame, name: str, seq: str, length: int, seed: int) -> DataFrame:
    """Sequences with one indel of ``length`` each and where it is: (name, seq, at, deleted, inserted).

    A hash of the name decides on the place, and on deletion or insertion; sequences that
    are not longer than ``length`` stay as they are.
    """
    room = F.length(seq) - length
    at = F.floor(_draw(name, F.lit(seed)) * room).cast("int")
    cut = _draw(name, F.lit(seed + 1)) < 0.5
    own = sequences.select(name, F.col(seq).alias("__s"), F.when(room > 0, at).alias("at"), cut.alias("__cut"))
    rest = lambda n: F.col("__s").substr(F.col("at") + 1 + n, F.length("__s"))
    gone = F.when(F.col("__cut"), F.col("__s").substr(F.col("at") + 1, F.lit(length))).otherwise("")
    added = F.when(F.col("__cut"), "").otherwise(F.substring(F.repeat(F.lit("ACGT"), 1 + length // 4), 1, length))
    new = F.concat(F.substring("__s", 1, F.col("at")), F.when(F.col("__cut"), rest(length)).otherwise(F.concat(added, rest(0))))
    return own.select(name, F.coalesce(new, "__s").alias(seq), "at", F.when(F.col("at").isNotNull(), gone).alias("deleted"), F.when(F.col("at").isNotNull(), added).alias("inserted"))


def piped(lines: DataFrame, column: str, command: Sequence[str]) -> DataFrame:
    """(value): what a command writes for the lines of each partition, which it reads as text.

    Repartition before for the number of slices. A command that fails fails its task, which is then tried again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = "".join(f"{x}\n" for x in b[column].dropna())
            if text:
                got = subprocess.run(list(command), input=text, capture_output=True, text=True, check=True).stdout
                yield pd.DataFrame({"value": got.splitlines()})

    return lines.select(column).mapInPandas(run, "value string")


def predicted(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], name: str = "prediction", kind: str = "double") -> DataFrame:
    """``df`` with a model's answer for each row; ``predict`` gets batches of all columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = predict(b)
            yield b

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, `{name}` {kind}")
