"""Reads: tallies, qualities, composition, weights, seeds; genomes in blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.operators.sweep import running_sum

BLOCK = 1 << 16
#: As many different seeds are sent to all tasks.
SEEDS = 1 << 20
#: As many bases of blocks that points ask for are sent to all tasks.
HELD = 1 << 25
#: Characters that one histogram of qualities is made of.
PART = 1 << 20


def tally(reads: DataFrame, seq: str) -> DataFrame:
    """(sequence, n) of equal sequences; the first digest pass is not needed."""
    return reads.groupBy(seq).agg(F.count("*").alias("n"))


def composition(reads: DataFrame, seq: str, words: list[str]) -> DataFrame:
    """Occurrences, overlapping ones too, of each word in all sequences (A10)."""
    counts = reads.agg(*(F.sum(F.regexp_count(seq, F.lit(f"(?={w})"))).alias(f"w{i}") for i, w in enumerate(words)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)))).alias("x")).select("x.*")


def quality_by_position(reads: DataFrame, quality: str, encoding: str = "sanger") -> DataFrame:
    """Mean and exact quartiles of the scores at each read position."""
    offset, least = sq.ENCODINGS[encoding]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[np.ndarray] = []
            for i, text in enumerate(batch.column(0).to_pylist()):
                if text:
                    part.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
                if part and (sum(map(len, part)) > PART or i == batch.num_rows - 1):
                    sizes = np.array([len(x) for x in part])
                    code = np.concatenate(part).astype(np.int64)
                    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    key, n = np.unique(at << 22 | np.maximum(code - offset, least) + 64, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key >> 22).astype(np.int32)), pa.array(((key & (1 << 22) - 1) - 64).astype(np.int32)), pa.array(n)], names=["position", "score", "n"])
                    part = []

    # a histogram for each part of a batch, so that no character is a row of its own
    each = reads.select(F.col(quality).cast("string").alias("q")).mapInArrow(counted, "position int, score int, n bigint")
    hist = each.groupBy("position", "score").agg(F.sum("n").alias("n"))
    w = W.partitionBy("position")
    ranked = hist.withColumn("upto", F.sum("n").over(w.orderBy("score").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("score"))).alias(f"q{p}")
    return ranked.groupBy("position").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), q(25), q(50), q(75))


def quality_overview(reads: DataFrame, quality: str, n: int) -> DataFrame:
    """Least, largest and mean code of the first n reads and the encoding they suggest."""
    codes = reads.limit(n).select(F.explode(F.filter(F.split(quality, ""), lambda c: c != "")).alias("c")).select(F.ascii("c").alias("c"))
    got = codes.agg(F.min("c").alias("least"), F.max("c").alias("most"), F.avg("c").alias("mean"))
    return got.withColumn("encoding", sq.encoding_of(F.col("least"), F.col("most")))


def overview(df: DataFrame, length: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row of file statistics: rows, bases, least, largest and mean length, and shares given."""
    shares = [F.avg(c.cast("int")).alias(n) for n, c in (extra or {}).items()]
    return df.agg(F.count("*").alias("rows"), F.sum(length).alias("bases"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean"), *shares)


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Distinct values of a column."""
    return df.agg((F.count_distinct(column) if exact else F.approx_count_distinct(column, 0.01)).alias("distinct"))


def words_at(reads: DataFrame, seq: str, size: int = 7, ends: tuple[int, int] = (1, 2), body: tuple[int, int] = (20, 26)) -> DataFrame:
    """(word, weight): mean frequency at the positions of the body over that at the start."""
    places = [*range(ends[0], ends[1] + 1), *range(body[0], body[1] + 1)]
    at = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.substring(seq, p, size).alias("word")) for p in places)))
    each = reads.select(at.alias("x")).select("x.*").where((F.length("word") == size) & ~F.contains("word", F.lit("N")))
    total = W.partitionBy("p")
    freq = each.groupBy("p", "word").agg(F.count("*").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(total))
    mean = lambda lo, hi: F.sum(F.when(F.col("p").between(lo, hi), F.col("f")).otherwise(0)) / (hi - lo + 1)
    return freq.groupBy("word").agg(mean(*body).alias("body"), mean(*ends).alias("start")).where("start > 0").select("word", (F.col("body") / F.col("start")).alias("weight"))


def word_weights(reads: DataFrame, seq: str, weights: DataFrame, size: int = 7) -> DataFrame:
    """reads with the weight of their first word, 1 where unknown."""
    own = reads.withColumn("__word", F.substring(seq, 1, size))
    return own.join(weights.withColumnRenamed("word", "__word"), "__word", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("__word")


def frequency_table(df: DataFrame, position: str, base: str, bases: list[str]) -> DataFrame:
    """Counts by position, one column for each base."""
    return df.groupBy(position).pivot(base, bases).agg(F.count(F.lit(1))).na.fill(0)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """array<struct<number, frequency>> of a value by keys, from pre-aggregated counts."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("frequency"))
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("number"), "frequency"))).alias("histogram"))


def base_information(obs: DataFrame, histograms: list[str]) -> DataFrame:
    """Sites with their samples' allele counts by strand and histograms (S27, T27): nested rows of (pos, samples)."""
    n = obs.groupBy("pos", "sample", "allele").agg(F.sum((F.col("strand") == "O").cast("long")).alias("forward"), F.sum((F.col("strand") != "O").cast("long")).alias("reverse"))
    for h in histograms:
        n = n.join(histogram(obs, ["pos", "sample", "allele"], h).withColumnRenamed("histogram", h), ["pos", "sample", "allele"], "left")
    per = n.groupBy("pos", "sample").agg(F.array_sort(F.collect_list(F.struct("allele", "forward", "reverse", *histograms))).alias("counts"))
    return per.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("sample", "counts"))).alias("samples"))


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(property, least, most) of columns, for scaling features."""
    got = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(f"min_{c}").cast("double").alias("least"), F.col(f"max_{c}").cast("double").alias("most")) for c in columns))).alias("x")).select("x.*")


def _cut(seq: Column, block: int) -> Column:
    """A text as an array of pieces of ``block`` characters, in one pass over it."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))


def genome_blocks(sequences: DataFrame, name: str, seq: str, block: int = BLOCK) -> DataFrame:
    """(target, block, bases): sequences cut to blocks for joins (S15, 1.1-9)."""
    own = sequences.select(F.col(name).alias("target"), (F.col(seq) == "").alias("__none"), F.posexplode_outer(_cut(F.col(seq), block)).alias("__b", "__s"))
    return own.select("target", F.coalesce("__b", F.lit(0)).alias("block"), F.when(F.col("__none"), "").otherwise(F.col("__s")).alias("bases"))


def genome_get(points: DataFrame, blocks: DataFrame, target: str, pos: str, length: int = 1, block: int = BLOCK) -> DataFrame:
    """points with the bases from 0-based ``pos`` on, over block ends too."""
    own = points.withColumn("__t", F.col(target)).withColumn("__b", F.floor(F.col(pos) / block).cast("int"))
    # each block with the beginning of the next one, in one pass over the blocks
    both = F.array(F.struct(F.col("block").alias("__b"), F.col("bases").alias("__one"), F.lit(None).cast("string").alias("__two")), F.struct((F.col("block") - 1).alias("__b"), F.lit(None).cast("string").alias("__one"), F.substring("bases", 1, length - 1).alias("__two")))
    each = blocks.select(F.col("target").alias("__t"), F.explode(both).alias("__x")).select("__t", "__x.*")
    # where few blocks are asked for, each by many points, no point is dealt by its block
    asked = own.select("__t", "__b").distinct()
    few = asked.limit(HELD // (block + length) + 1).count() <= HELD // (block + length)
    if few:
        each = each.join(F.broadcast(asked), ["__t", "__b"], "left_semi")
    stretches = each.groupBy("__t", "__b").agg(F.max("__one").alias("__one"), F.max("__two").alias("__two"))
    got = own.join(F.broadcast(stretches) if few else stretches, ["__t", "__b"], "left")
    all_ = F.concat("__one", F.coalesce("__two", F.lit("")))
    return got.withColumn("bases", all_.substr((F.col(pos) % block + 1).cast("int"), F.lit(length))).drop("__t", "__b", "__one", "__two")


def joined_blocks(parts: DataFrame, target: str, order: str, seq: str, block: int = BLOCK) -> DataFrame:
    """(target, block, bases) of the targets that ``parts`` make when put end to end by ``order``; no row holds a whole target."""
    own = parts.select(F.col(target).alias("target"), F.col(order).alias("__o"), F.col(seq).alias("__s"), F.length(seq).cast("long").alias("__n")).where("__n > 0")
    ends = running_sum(own.select("target", "__o", "__n"), ["target"], ["__o"], {"__end": "__n"})
    placed = own.join(ends.select("target", "__o", (F.col("__end") - F.col("__n")).alias("__at"), "__end"), ["target", "__o"])
    skip = ((block - F.col("__at") % block) % block).cast("int")
    head = F.when(skip > 0, F.array(F.substring("__s", F.lit(1), skip))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(head, _cut(F.col("__s").substr(skip + 1, F.col("__n").cast("int")), block))
    each = placed.select("target", "__at", F.posexplode(pieces).alias("__i", "__piece")).select("target", (F.floor(F.col("__at") / block) + F.col("__i")).cast("int").alias("block"), "__at", "__piece")
    sorted_pieces = F.array_sort(F.collect_list(F.struct("__at", "__piece")))
    return each.groupBy("target", "block").agg(F.array_join(F.transform(sorted_pieces, lambda x: x["__piece"]), "").alias("bases"))


def _stretches(genome: DataFrame, size: int) -> DataFrame:
    """(target, block, bases): blocks with as much of the next one as a word that begins in them can reach."""
    more = genome.select("target", (F.col("block") - 1).alias("block"), F.substring("bases", 1, size - 1).alias("__two"))
    return genome.join(more, ["target", "block"], "left").select("target", "block", F.concat("bases", F.coalesce("__two", F.lit(""))).alias("bases"))


def _word_counts(stretches: DataFrame, size: int) -> DataFrame:
    """(word, n): counts of the words of ``bases``, a count for each part of a batch, so that no place is a row of its own."""

    def words_of(texts: list[str]) -> tuple[list[str], list[int]]:
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        letters, at = np.unique(code, return_inverse=True)
        bits = max(1, (len(letters) - 1).bit_length())
        if bits * size > 62:
            n = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
            return list(n), list(n.values())
        ends = np.cumsum([len(t) for t in texts])
        whole = np.ones(len(code) - size + 1, bool)
        for k in range(1, size):
            cut = ends[:-1] - k  # a word from here would run into the next text
            whole[cut[(cut >= 0) & (cut < len(whole))]] = False
        packed = np.zeros(len(whole), np.int64)
        for k in range(size):
            packed = packed << bits | at[k : k + len(whole)]
        found, n = np.unique(packed[whole], return_counts=True)
        shifts = np.arange(size - 1, -1, -1) * bits
        text = letters[found[:, None] >> shifts & (1 << bits) - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + size] for i in range(0, len(text), size)], n.tolist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, held = [], 0
            for i, text in enumerate(batch.column(0).to_pylist()):
                if text and len(text) >= size:
                    part.append(text)
                    held += len(text)
                if part and (held > PART or i == batch.num_rows - 1):
                    words, n = words_of(part)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
                    part, held = [], 0

    return stretches.select("bases").mapInArrow(counted, "word string, n bigint")


def _block_words(genome: DataFrame, size: int) -> DataFrame:
    """(target, block, offset, word) of all words of a genome's blocks, those over block ends too."""
    both = _stretches(genome, size)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("bases") - size + 1, F.lit(1))))
    return both.select("target", "block", at.alias("offset"), "bases").select("target", "block", "offset", F.col("bases").substr(F.col("offset"), F.lit(size)).alias("word")).where(F.length("word") == size)


def seed_counts(reads: DataFrame, genome: DataFrame, seq: str, size: int) -> DataFrame:
    """``reads`` that have them, with the number of all ``seed_hits``; no pair is formed."""
    own = reads.withColumn("word", F.substring(seq, 1, size))
    seeds = own.where(F.length("word") == size).select("word").distinct()
    seeds = F.broadcast(seeds) if seeds.limit(SEEDS + 1).count() <= SEEDS else seeds
    n = _word_counts(_stretches(genome, size), size).join(seeds, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("hits"))
    return own.join(n, "word").drop("word")


def seed_hits(reads: DataFrame, genome: DataFrame, seq: str, size: int, most: int) -> DataFrame:
    """Exact matches of reads' first ``size`` bases in a genome's blocks, over block ends too, at most ``most`` each."""
    words = _block_words(genome, size)
    hits = reads.withColumn("word", F.substring(seq, 1, size)).join(words, "word")
    w = W.partitionBy(*reads.columns).orderBy("target", "block", "offset")
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r", "word")


def sex_ratio(df: DataFrame, sample: str, target: str, x: str = "X", y: str = "Y", threshold: float = 100) -> DataFrame:
    """Hits on X over hits on Y by sample; female at the threshold or more (A25; Q16: Y by name)."""
    n = lambda t: F.sum((F.col(target) == t).cast("long"))
    got = df.groupBy(sample).agg(n(x).alias("x"), n(y).alias("y"))
    ratio = F.when(F.col("y") > 0, F.col("x") / F.col("y"))
    return got.withColumn("ratio", ratio).withColumn("sex", F.when((F.col("y") == 0) & (F.col("x") == 0), "unknown").when(F.coalesce(ratio, F.lit(float("inf"))) >= threshold, "female").otherwise("male"))


def simulated(spark, n: int, genome: str, length: int, seed: int) -> DataFrame:
    """n reads of a sequence at positions and strands by a hash of the seed."""
    h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(1, len(genome) - length + 1)))
    reads = spark.range(n).select("id", h.cast("int").alias("pos"), (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(2)) == 1).alias("reverse"))
    seq = F.lit(genome).substr(F.col("pos") + 1, F.lit(length))
    return reads.withColumn("seq", F.when(F.col("reverse"), sq.reverse_complement(seq)).otherwise(seq))


def segment_information(obs: DataFrame, gap: int) -> DataFrame:
    """(start, end, sites): sites at most ``gap`` apart as one nested row; sites: array<struct<pos, bases, samples>>."""
    from lociform.operators.sweep import islands, previous

    sites = obs.groupBy("pos").agg(F.count("*").alias("bases"), F.count_distinct("sample").alias("samples"))
    seen = previous(sites.withColumn("__k", F.lit(0)), ["__k"], ["pos"], F.col("pos"), "__before")
    cut = islands(seen, ["__k"], ["pos"], F.coalesce(F.col("pos") - F.col("__before") > gap, F.lit(True)), "__segment")
    got = cut.groupBy("__segment").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.array_sort(F.collect_list(F.struct("pos", "bases", "samples"))).alias("sites"))
    return got.drop("__segment")
