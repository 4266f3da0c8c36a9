"""Run-length coverage and the algebra of step functions.

A step function is a table (keys, start, length, count); intervals are half-open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.operators.sweep import block_of, islands, largest_before, latest, previous, running_sum, swept
from lociform.scratch import stored


def _steps(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, length, count) from (keys, pos, delta): runs between changes, none after the last."""
    changes = events.groupBy(*keys, "pos").agg(F.sum("delta").alias("delta")).where("delta != 0")
    return swept(changes, keys, "pos", {"count": "delta"}).where("next_pos IS NOT NULL").select(*keys, F.col("pos").alias("start"), (F.col("next_pos") - F.col("pos")).alias("length"), "count")


def coverage(df: DataFrame, keys: list[str], start: str, end: str, weight: Column | None = None, leading: bool = True, closed: bool = False) -> DataFrame:
    """Depth of [start, end) intervals as maximal runs (A1, A2, A3, A5, W1-W3; Q7: ``closed`` adds the end).

    ``weight`` replaces the 1 that an interval adds. ``leading`` puts a run of 0 from
    position 0 to the first change. Intervals with a null bound or no length add nothing.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    own = df.select(*keys, F.col(start).cast("long").alias("s"), (F.col(end).cast("long") + int(closed)).alias("e"), w.alias("w")).where("s < e")
    events = own.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("pos"), F.col("w").alias("delta")), F.struct(F.col("e").alias("pos"), (-F.col("w")).alias("delta")))).alias("x")).select(*keys, "x.*")
    runs = _steps(events, keys)
    if not leading:
        return runs
    first = runs.groupBy(*keys).agg(F.min("start").alias("length")).where("length > 0")
    return runs.unionByName(first.select(*keys, F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast(runs.schema["count"].dataType).alias("count")))


def start_histogram(df: DataFrame, keys: list[str], start: str, end: str, reverse: Column, strand: str = "both") -> DataFrame:
    """Reads by the position of their first base: start, or the last base of reverse reads (A4, F30; Q23: strand first)."""
    kept = df if strand == "both" else df.where(reverse if strand == "reverse" else ~reverse)
    return kept.groupBy(*keys, F.when(reverse, F.col(end) - 1).otherwise(F.col(start)).cast("long").alias("pos")).agg(F.count("*").alias("n"))


def _deltas(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    end = (F.col("start") + F.col("length")).alias("pos")
    return steps.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("count").alias(value)), F.struct(end, (-F.col("count")).alias(value)))).alias("x")).select(*keys, "x.*")


def step_union(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each segment between neighbouring breakpoints of any source, every source's count and their total.

    Counts are running sums of each source's changes, so no join is needed; offsets (J10)
    are applied by shifting ``start`` before.
    """
    names = list(sources)
    events = reduce(DataFrame.unionByName, (_deltas(df, keys, "d").select("*", F.lit(n).alias("src")) for n, df in sources.items()))
    points = events.groupBy(*keys, "pos").agg(*(F.sum(F.when(F.col("src") == n, F.col("d")).otherwise(0)).alias(f"d_{n}") for n in names))
    return _union(points, keys, names)


def _union(points: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    own = swept(points, keys, "pos", {n: f"d_{n}" for n in names}).where("next_pos IS NOT NULL")
    total = reduce(Column.__add__, map(F.col, names))
    return own.select(*keys, F.col("pos").alias("start"), (F.col("next_pos") - F.col("pos")).alias("length"), *names, total.alias("total"))


def sample_union(df: DataFrame, keys: list[str], start: str, end: str, sample: str, samples: list[str], shift: dict[str, int] | None = None) -> DataFrame:
    """``step_union`` of the coverage of each of ``samples``, from one scan of their intervals; ``shift`` moves samples."""
    moved = F.lit(0)
    for name, by in (shift or {}).items():
        moved = F.when(F.col(sample) == name, by).otherwise(moved)
    own = df.where(F.col(sample).isin(samples)).select(*keys, F.col(sample).alias("__s"), (F.col(start).cast("long") + moved).alias("s"), (F.col(end).cast("long") + moved).alias("e")).where("s < e")
    events = own.select(*keys, "__s", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("x")).select(*keys, "__s", "x.*")
    points = events.groupBy(*keys, "pos").agg(*(F.sum(F.when(F.col("__s") == n, F.col("d")).otherwise(0)).alias(f"d_{n}") for n in samples))
    return _union(points.where(" OR ".join(f"`d_{n}` != 0" for n in samples)), keys, samples)


def peaks(steps: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Maximal chains of adjacent runs above ``threshold``: start, length, summed run counts (Q10), area."""
    inside = W.partitionBy(*keys, "__blk").orderBy("start")
    above = steps.where(F.col("count") > threshold).withColumn("__blk", block_of("start"))
    opened = above.withColumn("__new", F.coalesce(F.lag(F.col("start") + F.col("length")).over(inside) != F.col("start"), F.lit(True)).cast("long"))
    sums = lambda c: (F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("count").alias("count"), F.sum(c).alias("area"))
    # the chains of each block, in one pass over the runs; only they are put together over the blocks
    parts = stored(opened.withColumn("__n", F.sum("__new").over(inside)).groupBy(*keys, "__blk", "__n").agg(*sums(F.col("count") * F.col("length"))).drop("__blk", "__n"))
    seen = previous(parts, keys, ["start"], F.col("start") + F.col("length"), "__before")
    chained = islands(seen, keys, ["start"], F.coalesce(F.col("__before") != F.col("start"), F.lit(True)), "__peak")
    return chained.groupBy(*keys, "__peak").agg(*sums("area")).select(*keys, "start", "length", F.col("count").alias("sum_transition_count"), "area")


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap, touch or lie within ``gap`` (A8, W6; Q8: the whole overlap test)."""
    own = df.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s < e")
    reach = largest_before(own, keys, ["s", "e"], "e", "__reach")
    grouped = islands(reach, keys, ["s", "e"], F.coalesce(F.col("s") > F.col("__reach") + gap, F.lit(True)), "__g")
    return grouped.groupBy(*keys, "__g").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("n")).drop("__g")


def depth_histogram(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Sites and bases at each depth."""
    return steps.groupBy(*keys, F.col("count").alias("depth")).agg(F.sum("length").alias("sites"), F.sum(F.col("length") * F.col("count")).alias("bases"))


def at_least(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Sites and bases at each depth or deeper."""
    w = W.partitionBy(*keys).orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    return histogram.select(*keys, "depth", F.sum("sites").over(w).alias("sites_at_least"), F.sum("bases").over(w).alias("bases_at_least"))


def depth_percentiles(histogram: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """The least depth that at most p percent of the covered sites stay below or reach, for each p."""
    covered = histogram.where("depth > 0")
    w = W.partitionBy(*keys).orderBy("depth")
    upto, total = F.sum("sites").over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum("sites").over(W.partitionBy(*keys))
    ranked = covered.select(*keys, "depth", upto.alias("upto"), total.alias("total"))
    asked = F.explode(F.array(*map(F.lit, percents))).alias("percent")
    return ranked.select("*", asked).where(F.col("upto") * 100 >= F.col("total") * F.col("percent")).groupBy(*keys, "percent").agg(F.min("depth").alias("depth"))


def wiggle(steps: DataFrame, keys: list[str], resolution: int) -> DataFrame:
    """Mean count over fixed windows, from the share of each run that a window covers."""
    end = F.col("start") + F.col("length")
    bins = F.explode(F.sequence(F.floor(F.col("start") / resolution), F.floor((end - 1) / resolution))).alias("bin")
    own = steps.where("count != 0").select(*keys, "start", end.alias("end"), "count", bins)
    part = F.least("end", (F.col("bin") + 1) * resolution) - F.greatest("start", F.col("bin") * resolution)
    return own.groupBy(*keys, (F.col("bin") * resolution).alias("start")).agg((F.sum(part * F.col("count")) / resolution).alias("mean"))


def count_bins(steps: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Fixed bins: mean over non-zero sites, mean over all sites, largest count (W9; Q20: both means)."""
    end = F.col("start") + F.col("length")
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))).alias("bin")
    own = steps.select(*keys, "start", end.alias("end"), "count", bins)
    part = F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)
    area, sites = F.sum(part * F.col("count")), F.sum(F.when(F.col("count") != 0, part))
    return own.groupBy(*keys, (F.col("bin") * width).alias("start")).agg((area / sites).alias("mean_nonzero"), (area / width).alias("mean_all"), F.max("count").alias("largest"))


def adaptive_bins(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One bin for each maximal chain of zero or of non-zero runs: mean and largest count."""
    kind = (F.col("count") == 0).cast("int")
    seen = previous(steps, keys, ["start"], F.struct(kind.alias("kind"), (F.col("start") + F.col("length")).alias("end")), "__before")
    own = islands(seen, keys, ["start"], F.coalesce((F.col("__before.kind") != kind) | (F.col("__before.end") != F.col("start")), F.lit(True)), "__bin")
    return own.groupBy(*keys, "__bin").agg(F.min("start").alias("start"), F.sum("length").alias("length"), (F.sum(F.col("length") * F.col("count")) / F.sum("length")).alias("mean"), F.max("count").alias("largest")).drop("__bin")


def captured(steps: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Sites and bases by depth, inside and outside of target intervals."""
    both = step_union({"depth": steps, "wanted": coverage(targets, keys, "start", "end", leading=False)}, keys)
    return both.groupBy(*keys, (F.col("wanted") > 0).alias("inside"), F.col("depth")).agg(F.sum("length").alias("sites"), F.sum(F.col("length") * F.col("depth")).alias("bases"))


def capture_summary(histogram: DataFrame) -> DataFrame:
    """Mean depths over and inside of targets, and the share of covered bases inside (A9; Q5: labels as named)."""
    some = histogram.where("depth != 0")
    inside = lambda c: F.sum(F.when(F.col("inside"), F.col(c)))
    return some.agg((F.sum("bases") / F.sum("sites")).alias("average_depth"), (inside("bases") / inside("sites")).alias("average_depth_captured"), (inside("bases") / F.sum("bases")).alias("enrichment"))


def set_distance(a: DataFrame, b: DataFrame, keys: list[str], cost_apart: float = 1.0, cost_shared: float = 0.0) -> DataFrame:
    """Cost of the bases that only one of two interval sets covers, and of those both cover."""
    both = step_union({"a": coverage(a, keys, "start", "end", leading=False), "b": coverage(b, keys, "start", "end", leading=False)}, keys)
    one, shared = (F.col("a") > 0) != (F.col("b") > 0), (F.col("a") > 0) & (F.col("b") > 0)
    bases = lambda c: F.sum(F.when(c, F.col("length")).otherwise(0))
    return both.groupBy(*keys).agg(bases(one).alias("apart"), bases(shared).alias("shared"), (bases(one) * cost_apart + bases(shared) * cost_shared).alias("penalty"))


def depth_at(steps: DataFrame, points: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """``points`` with the count of the run that covers ``pos``, 0 outside (J6 on step functions)."""
    marks = steps.select(*keys, F.col("start").alias("__pos"), F.lit(0).alias("__tie"), F.struct("count", (F.col("start") + F.col("length")).alias("end")).alias("__run"))
    asked = points.select(*keys, F.col(pos).cast("long").alias("__pos"), F.lit(1).alias("__tie"), F.struct(*points.columns).alias("__row"))
    found = latest(marks.unionByName(asked, allowMissingColumns=True), keys, ["__pos", "__tie"], F.col("__run"), "__at").where("__tie = 1")
    return found.select("__row.*", F.when(F.col("__at.end") > F.col("__pos"), F.col("__at.count")).otherwise(0).alias("depth"))


def rle(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Runs of equal values at adjacent positions from one row for each position."""
    seen = previous(df, keys, [pos], F.struct(F.col(value).alias("v"), F.col(pos).alias("p")), "__before")
    own = islands(seen, keys, [pos], F.coalesce((F.col("__before.v") != F.col(value)) | (F.col("__before.p") + 1 != F.col(pos)), F.lit(True)), "__run")
    return own.groupBy(*keys, "__run").agg(F.min(pos).alias("start"), F.count("*").alias("length"), F.first(value).alias("count")).drop("__run")
