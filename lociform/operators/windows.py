"""Trailing windows, ordered folds and regional tests along a coordinate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.operators.sweep import islands, largest_before, previous, reaching, running_sum


def trailing(df: DataFrame, keys: list[str], pos: str, distance: int, values: dict[str, Column]) -> DataFrame:
    """Aggregates over the ``distance`` positions up to each row.

    Blocks of ``distance`` positions are windowed by themselves; each also holds the rows of the block before.
    Any aggregate will do, at the cost of all rows in each window; sums and counts go by ``trailing_sums``.
    """
    near = reaching(df, keys, pos, distance)
    w = W.partitionBy(*keys, "__blk").orderBy(pos).rangeBetween(-distance, 0)
    return near.withColumns({n: c.over(w) for n, c in values.items()}).where("__own").drop("__blk", "__own")


def trailing_sums(df: DataFrame, keys: list[str], pos: str, distance: int, values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` (a column of each row; 1 counts rows) over the ``distance`` positions up to each row.

    A window that moves at both ends is summed anew for each row, at a cost of the rows in it.
    Here it is the rows of the own block of ``distance`` positions up to the row, and those of the
    block before that still reach it: two running sums, and no difference of large ones.
    """
    blk, at = F.floor(F.col(pos) / F.lit(max(distance, 1))), F.col(pos)
    names = [f"__v{i}" for i in range(len(values))]
    row = F.struct(*(F.col(c) for c in df.columns))
    v = F.struct(*(c.alias(n) for n, c in zip(names, values.values(), strict=True)))
    sides = F.array(F.struct(blk.alias("b"), at.alias("x"), row.alias("row"), v.alias("v")), F.struct((blk + 1).alias("b"), (at + distance).alias("x"), F.lit(None).cast(df.schema).alias("row"), v.alias("v")))
    each = df.select(*keys, F.explode(F.when(at.isNull(), F.slice(sides, 1, 1)).otherwise(sides)).alias("__s")).select(*keys, "__s.*")
    part = W.partitionBy(*keys, "b")
    upto, from_ = (part.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc("x"), F.desc("x")))
    own = F.col("row").isNotNull()
    sums = {}
    for n in names:
        inside, before = F.sum(F.when(own, F.col(f"v.{n}"))).over(upto), F.sum(F.when(~own, F.col(f"v.{n}"))).over(from_)
        sums[n] = F.coalesce(inside + before, inside, before)
    got = each.select("row", *(c.alias(n) for n, c in sums.items())).where("row IS NOT NULL")
    return got.select("row.*", *(F.col(n).alias(k) for n, k in zip(names, values, strict=True)))


def last_sites(df: DataFrame, keys: list[str], order: list[str], n: int, values: dict[str, Column]) -> DataFrame:
    """Aggregates over the last n rows in a unique order (W13), in blocks of rows that also hold the n - 1 rows before."""
    block = max(n, 1 << 16)
    ranked = running_sum(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {"__rank": "__one"}).drop("__one")
    near = reaching(ranked, keys, "__rank", block).where(F.col("__own") | (F.col("__rank") % block > block - n))
    w = W.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(1 - n, 0)
    return near.withColumns({k: c.over(w) for k, c in values.items()}).where("__own").drop("__blk", "__own", "__rank")


def previous_distance(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Distance to the position before."""
    return previous(df, keys, [pos], F.col(pos), "__before").withColumn("distance", F.col(pos) - F.col("__before")).drop("__before")


def _folded(pieces: DataFrame, keys: list[str], columns: list[str], joins: Callable[[tuple, list], bool], moves: Callable[[tuple, list], None]) -> DataFrame:
    """(keys, start, end, n): runs of the rows of each ``__piece`` in the order of start and end.

    A row (start, end, ...) joins the run [start, end, n, anchor] if ``joins`` says so, and ``moves`` the
    anchor. A task holds one run at a time.
    """
    ordered = pieces.repartition(*keys, "__piece").sortWithinPartitions(*keys, "__piece", "start", "end").select(*keys, "__piece", *columns)
    n_keys = len(keys) + 1

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        run: list = []
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False, name=None):
                key, own = row[:n_keys], row[n_keys:]
                if key == now and joins(own, run):
                    run[1], run[2] = max(run[1], own[1]), run[2] + 1
                    moves(own, run)
                else:
                    if now is not None:
                        done.append((*now[:-1], *run[:3]))
                    now, run = key, [own[0], own[1], 1, own[-1]]
            yield pd.DataFrame(done, columns=[*keys, "start", "end", "n"])
        if now is not None:
            yield pd.DataFrame([(*now[:-1], *run[:3])], columns=[*keys, "start", "end", "n"])

    kinds = dict(ordered.dtypes)
    return ordered.mapInPandas(fold, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "start bigint", "end bigint", "n bigint"]))


def anchored(df: DataFrame, keys: list[str], threshold: int, anchor: str = "first") -> DataFrame:
    """(keys, start, end, n): runs of sorted intervals that lie within ``threshold`` of their anchor (W7; Q12).

    ``anchor`` is the run's ``first`` or ``last`` interval; end is exclusive. Where an
    interval begins further than the threshold behind all before it, a run ends for either
    anchor, so each stretch between such gaps is folded by itself.
    """
    own = largest_before(df.select(*keys, "start", "end"), keys, ["start", "end"], "end", "__reach")
    pieces = islands(own, keys, ["start", "end"], F.coalesce(F.col("start") - F.col("__reach") > threshold, F.lit(True)), "__piece")

    def moves(row: tuple, run: list) -> None:
        if anchor == "last":
            run[3] = row[1]

    return _folded(pieces, keys, ["start", "end"], lambda row, run: row[0] - run[3] <= threshold, moves)


def by_difference(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """As ``anchored``, by the difference of a value to that of the run's first interval.

    Where the value changes by more than twice the threshold from one interval to the next
    a run ends whatever its anchor is, so each stretch between such changes is folded by itself.
    """
    own = previous(df.select(*keys, "start", "end", value), keys, ["start", "end"], F.col(value), "__before")
    pieces = islands(own, keys, ["start", "end"], F.coalesce(F.abs(F.col(value) - F.col("__before")) > 2 * threshold, F.lit(True)), "__piece")
    return _folded(pieces, keys, ["start", "end", value], lambda row, run: abs(row[2] - run[3]) <= threshold, lambda row, run: None)


def slices(df: DataFrame, target: str, pos: str, n: int) -> DataFrame:
    """n ranges of (target, position) with about equal rows: the first key of each.

    Ranks come from counts by position, numbered per target and offset by the targets before.
    """
    at = df.groupBy(target, pos).agg(F.count("*").alias("n"))
    per = at.groupBy(target).agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy(F.lit(0)).orderBy(target).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(target, before.alias("__before"), F.sum("t").over(W.partitionBy(F.lit(0))).alias("__all"))  # one row for each target
    upto = F.sum("n").over(W.partitionBy(target).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    ranked = at.withColumn("__in", F.coalesce(upto, F.lit(0))).join(per, target)
    part = F.floor((F.col("__before") + F.col("__in")) * n / F.col("__all")).cast("int")
    return ranked.withColumn("slice", part).groupBy("slice").agg(F.min(F.struct(target, pos)).alias("first")).select("slice", f"first.{target}", f"first.{pos}")


def methylation(obs: DataFrame, keys: list[str], reference: str, base: str, reverse: Column) -> DataFrame:
    """Methylated and other counts and rate by site (A19): C on the forward strand, G on the reverse; the reference base is methylated."""
    ref = F.upper(reference)
    own = obs.where(((ref == "C") & ~reverse) | ((ref == "G") & reverse))
    same = F.upper(base) == ref
    got = own.groupBy(*keys).agg(F.sum(same.cast("long")).alias("methylated"), F.sum((~same).cast("long")).alias("unmethylated"))
    return got.withColumn("rate", 100 * F.col("methylated") / (F.col("methylated") + F.col("unmethylated")))


def region_rates(sites: DataFrame, regions: DataFrame, keys: list[str], pos: str, by: list[str], width: int) -> DataFrame:
    """Counts of sites averaged over the regions that hold them, by context, sample or group."""
    from lociform.operators.intervals import points_in_intervals

    both = points_in_intervals(sites, regions, keys, pos, width)
    names = [c for c in regions.columns if c not in keys]
    got = both.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys), *(F.col(f"a.{c}").alias(c) for c in names), *(F.col(f"p.{c}").alias(c) for c in by)).agg(F.count("*").alias("sites"), F.sum("p.methylated").alias("methylated"), F.sum("p.unmethylated").alias("unmethylated"))
    return got.withColumn("rate", 100 * F.col("methylated") / (F.col("methylated") + F.col("unmethylated")))


def rates_by_sample_and_group(sites: DataFrame, sample: str, group: str) -> DataFrame:
    """Rates of samples and of groups in one table (A19, A22 outputs) by grouping sets."""
    got = sites.groupingSets([[F.col(sample)], [F.col(group)]], F.col(sample), F.col(group)).agg(F.sum("methylated").alias("methylated"), F.sum("unmethylated").alias("unmethylated"))
    return got.withColumn("rate", 100 * F.col("methylated") / (F.col("methylated") + F.col("unmethylated")))


def methylation_summary(sites: DataFrame, keys: list[str], pos: str, depth_bins: list[int]) -> DataFrame:
    """Sites by depth class with their conversion and the share near the site before."""
    depth = F.col("methylated") + F.col("unmethylated")
    kind = F.lit(0)
    for i, d in enumerate(sorted(depth_bins)):
        kind = F.when(depth >= d, i + 1).otherwise(kind)
    own = previous_distance(sites.withColumn("depth_class", kind), keys, pos)
    return own.groupBy("depth_class").agg(F.count("*").alias("sites"), F.sum("methylated").alias("methylated"), F.sum("unmethylated").alias("unmethylated"), F.sum(F.when(F.col("distance") <= 100, 1).otherwise(0)).cast("long").alias("near"))


def strand_similarity(sites: DataFrame, keys: list[str], pos: str, window: int, k: int) -> DataFrame:
    """Top k windows by |sum of rates forward - reverse| / larger site count."""
    by = sites.withColumn("win", F.floor(F.col(pos) / window))
    pick = lambda f, c: f(F.when(c, F.col("rate")))
    fwd, rev = ~F.col("reverse"), F.col("reverse")
    got = by.groupBy(*keys, "win").agg(pick(F.sum, fwd).alias("f"), pick(F.sum, rev).alias("r"), pick(F.count, fwd).alias("nf"), pick(F.count, rev).alias("nr")).where("nf > 0 AND nr > 0")
    score = F.abs(F.col("f") - F.col("r")) / F.greatest("nf", "nr")
    ranked = got.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "win")))
    return ranked.where(F.col("rank") <= k).select(*keys, (F.col("win") * window).alias("start"), "score", "rank")


def differing_regions(sites: DataFrame, key: str, p_most: float = 0.01, least_sites: int = 3, gap: int = 1000) -> DataFrame:
    """(key, start, end, sites, p) of regions whose counts differ between two groups (W14; Q22).

    sites: (key, pos, ma, ua, mb, ub). Sites split into stretches at gaps; a stretch whose
    summed table isn't significant is divided into thirds, each tested by itself.
    """
    from lociform.functions.tails import fisher_two_sided

    seen = previous(sites, [key], ["pos"], F.col("pos"), "__before")
    cut = islands(seen, [key], ["pos"], F.coalesce(F.col("pos") - F.col("__before") > gap, F.lit(True)), "__part")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        sums = pdf[["ma", "ua", "mb", "ub"]].cumsum().to_numpy()
        pos, out, todo = pdf["pos"].to_numpy(), [], [(0, len(pdf))]
        while todo:
            a, z = todo.pop()
            if z - a < least_sites:
                continue
            t = sums[z - 1] - (sums[a - 1] if a else 0)
            p = float(fisher_two_sided(*([x] for x in t))[0])
            if p <= p_most:
                out.append((pdf[key].iloc[0], int(pos[a]), int(pos[z - 1]) + 1, z - a, p))
            else:
                third = (z - a) // 3
                if third:
                    todo += [(a, a + third), (a + third, a + 2 * third), (a + 2 * third, z)]
        return pd.DataFrame(out, columns=[key, "start", "end", "sites", "p"])

    kind = dict(sites.dtypes)[key]
    return cut.select(key, "__part", "pos", "ma", "ua", "mb", "ub").groupBy(key, "__part").applyInPandas(search, f"`{key}` {kind}, start bigint, end bigint, sites bigint, p double")


def per_target(df: DataFrame, key: str, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """A fold over each key's rows in any order (W17, E3): ``state = step(state, batch)``, then rows ``finish(key, state)``.

    A key's batches stream through one task with only its state in memory.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]
    ordered = df.repartition(key).sortWithinPartitions(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for batch in batches:
            done: list = []
            for own, part in batch.groupby(key, sort=False, dropna=False):
                if begun and own != now:
                    done += finish(now, state)
                    state = None
                now, state, begun = own, step(state, part), True
            yield pd.DataFrame(done, columns=names)
        if begun:
            yield pd.DataFrame(finish(now, state), columns=names)

    return ordered.mapInPandas(run, schema)
