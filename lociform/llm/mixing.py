"""Mixing sources to target weights by hierarchical budgets, in DataFrame expressions only.

A token budget goes down a tree of domains, languages and sources. At every node the
children share by weight; a child that cannot use its share (its tokens times the epochs
allowed) gets what it can and its siblings divide the rest by weight, so a shortage
reaches a node's ancestors only when all its children are short. A leaf then takes whole
seeded epochs and, of one more epoch, the prefix that fits into what remains.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.llm.common import checkpointed, if_small, table

LEVELS = ("domain", "lang", "source")
#: Leaves times pieces of them up to which their table is broadcast.
SMALL = 100_000
#: Hash digits that cut a leaf's epoch into pieces: 16**3.
DIGITS = 3
SEED = 17
MAX_EPOCHS = 2
#: Weights by level and name; a name that isn't listed weighs 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def token_count(text: Column) -> Column:
    """Words between ASCII spaces; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Four domains, by the number that a source's name ends with; 0 without one."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(0)) % 4)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = F.lit(1)
    for name, w in weights.get(level, {}).items():
        given = F.when(F.col(level) == name, w).otherwise(given)
    return given.cast("long")


def _shared(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """nodes (parents, level, cap, weight, budget of the parent) with ``share``, the budget of each.

    In ascending order of cap / weight the children that fill up come first: a child fills
    up if the budget, given to those before it in full and to the rest by weight, reaches
    its cap. Whole numbers only, so every engine gives the same.
    """
    own = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = own.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(level).asc())
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.withColumn("cap_upto", F.sum("cap").over(upto)).withColumn("w_upto", F.sum("weight").over(upto)).withColumn("w_all", F.sum("weight").over(own))
    dec = lambda x: F.col(x).cast("decimal(30,0)")
    full = dec("cap_upto") * F.col("weight") + dec("cap") * (F.col("w_all") - F.col("w_upto")) <= dec("budget") * F.col("weight")
    nodes = nodes.withColumn("full", F.coalesce(full, F.lit(False)))
    # a child is full only if all before it are
    nodes = nodes.withColumn("full", F.min("full").over(upto))
    nodes = nodes.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(own), F.lit(0))).withColumn("w_spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(own), F.lit(0)))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(CAST(budget AS DECIMAL(20,0)) - spent) * weight DIV (w_all - w_spent)"))
    return nodes.withColumn("share", share.cast("long")).drop("cap_upto", "w_upto", "w_all", "full", "spent", "w_spent")


def budgets(leaves: DataFrame, budget: int | None, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, share) of leaves (domain, lang, source, tokens).

    ``budget``: tokens in all, those of the leaves if None.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("tokens").over(W.partitionBy(F.lit(0)))
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        keys, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap"), F.sum("tokens").cast("long").alias("tokens")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("budget", total) if above is None else nodes.join(above, parents)
        above = _shared(nodes, parents, level).select(*keys, F.col("share").alias("budget"), "tokens")
        if depth < len(LEVELS) - 1:
            above = above.drop("tokens")
    return above.withColumnRenamed("budget", "share")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", budget: int | None = None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """``docs`` with __domain, __lang, __source, __tokens and __epoch, one row for each time a row is taken.

    Epoch k of a leaf is all its rows; the last epoch is cut. Its order is that of
    md5(seed, epoch, id); rows are taken while the tokens up to and with them (and with
    rows of the same id) fit. Null languages and sources are leaves of their own, named
    "". A null text counts no tokens, a leaf without tokens is taken once if it has a
    share of 0 and all. ``tokens`` counts a row's tokens in place of the words of its text.
    An empty table gives no rows; other columns stay, but columns of the five added names
    are replaced.
    """
    added = [*(f"__{x}" for x in LEVELS), "__tokens", "__epoch"]
    stay = [c for c in docs.columns if c not in added]
    inner = {c: f"own {i}" for i, c in enumerate(stay)}
    if tokens is None:
        tokens = token_count(F.col(text_col))
    lang, source = F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), domain_of(source).alias("__domain"), lang.alias("__lang"), source.alias("__source"), tokens.alias("__tokens"), ident.alias("__id"))
    names = [f"__{x}" for x in LEVELS]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), "__id"))
    # one row for each document without its text, written once: tokens aren't counted again for each use
    slim = checkpointed(own.select(*names, "__tokens", "__id"))
    leaves = slim.groupBy(*(F.col(f"__{x}").alias(x) for x in LEVELS)).agg(F.sum("__tokens").cast("long").alias("tokens"))
    share = budgets(checkpointed(leaves), budget, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("share DIV tokens")).otherwise(1)
    leaf = share.select(*(F.col(x).alias(f"__{x}") for x in LEVELS), whole.alias("__whole"), F.when(F.col("tokens") > 0, F.expr("share % tokens")).otherwise(0).alias("__rest"))
    leaf = if_small(checkpointed(leaf), SMALL)
    placed = slim.join(leaf, names).where("__rest > 0").withColumn("__order", key)
    piece = F.substring("__order", 1, DIGITS)
    # which piece of the cut epoch holds the end of the prefix
    pieces = placed.groupBy(*names, "__rest", piece.alias("__piece")).agg(F.sum("__tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(*names).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.withColumn("__before", F.coalesce(before, F.lit(0))).where("__before <= __rest")
    edge = checkpointed(pieces.where("__before + n > __rest").select(*names, "__piece", (F.col("__rest") - F.col("__before")).alias("__room")))
    inside = placed.select(*names, "__order", "__tokens").withColumn("__piece", piece).join(if_small(edge, SMALL), [*names, "__piece"])
    upto = F.sum("__tokens").over(W.partitionBy(*names).orderBy("__order").rangeBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("__upto", upto).where("__upto <= __room").groupBy(*names).agg(F.max("__order").alias("__last"))
    edge = edge.join(last, names, "left").select(*names, F.col("__piece").alias("__edge"), F.coalesce("__last", F.lit("")).alias("__last"))
    cut = if_small(checkpointed(edge), SMALL)
    placed = own.join(leaf, names).withColumn("__order", key).join(cut, names, "left")
    more = (F.col("__rest") > 0) & (F.col("__edge").isNull() | (piece < F.col("__edge")) | ((piece == F.col("__edge")) & (F.col("__order") <= F.col("__last"))))
    times = F.col("__whole") + F.when(more, 1).otherwise(0)
    taken = placed.withColumn("__times", times).where("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    return taken.select(*(F.col(n).alias(c) for c, n in inner.items()), *added)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """A budget of as many tokens as there are, with at most two epochs of a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", token_count(F.col("text")).alias("n"))
    return mix(checkpointed(docs), tokens=F.col("n")).select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"))


def _level_sql(level: str, parents: list[str], above: str, weights: Mapping[str, int]) -> str:
    case = f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    keys = ", ".join([*parents, level])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    upto = f"OVER ({part} ORDER BY CAST(cap AS DOUBLE) / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{level}_n AS (
  SELECT {keys}, sum(tokens) * {MAX_EPOCHS} AS cap, sum(tokens) AS tokens, {case} AS weight FROM leaves GROUP BY {keys}
), {level}_u AS (
  SELECT *, sum(cap) {upto} AS cap_upto, sum(weight) {upto} AS w_upto, sum(weight) OVER ({part}) AS w_all FROM {level}_n {join}
), {level}_f AS (
  SELECT *, min(CASE WHEN cap_upto * weight + cap * (w_all - w_upto) <= budget * weight THEN 1 ELSE 0 END) {upto} AS is_full FROM {level}_u
), {level}_s AS (
  SELECT {keys}, tokens AS leaf_tokens, CASE WHEN is_full = 1 THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full = 1) OVER ({part}), 0)) * weight
         // (w_all - coalesce(sum(weight) FILTER (is_full = 1) OVER ({part}), 0)) END AS budget FROM {level}_f
)"""


SQL = f"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
root AS (SELECT sum(tokens) AS budget FROM leaves),
{_level_sql("domain", [], "root", WEIGHTS["domain"])},
{_level_sql("lang", ["domain"], "(SELECT domain, budget FROM domain_s)", WEIGHTS["lang"])},
{_level_sql("source", ["domain", "lang"], "(SELECT domain, lang, budget FROM lang_s)", WEIGHTS["source"])},
placed AS (
  SELECT d.*, CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 1 END AS whole,
         CASE WHEN leaf_tokens > 0 THEN budget % leaf_tokens ELSE 0 END AS rest
  FROM docs d JOIN source_s USING (domain, lang, source)
), ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{SEED}:' || CAST(whole AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM placed
), times AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(times)) AS epoch FROM times
"""
