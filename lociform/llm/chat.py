"""Multi-party perspective rotation of conversations, in DataFrame expressions only.

For every participant the dialogue is rendered with that speaker as assistant and the
others as named users. The result is long: one row for each segment, with its place in
the rendered text and the range that a loss mask covers, so no conversation has to fit
into one row. Places are sums in two levels, over blocks of turns and inside a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns in a block; a block's rows are ordered in one task.
BLOCK = 512


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, turn, role, name, rendered, start, mask_start, mask_end).

    Participants are the roles of a conversation other than ``system`` and null; a
    conversation without any gives no rows. Turns of a null role are rendered as system
    turns. A null text is empty. Markers inside a text or a name are broken up by a space, and
    line feeds and other control characters of a rendered name become spaces, so that neither
    opens a turn; the columns speaker and name keep the role as it is. Rows are
    ordered by turn, then role, then text; null turns come first, repeated rows follow
    each other. ``start`` and the mask count characters of the whole rendering, ends
    exclusive; turns that are not the speaker's have an empty mask at their start.
    A null conv_id is a conversation of its own. Other columns are not read.
    """
    broken = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    clean = broken(F.coalesce(F.col(text_col), F.lit("")))
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("by"), clean.alias("content"))
    said = said.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    speakers = said.where("`by` IS NOT NULL AND `by` != 'system'").select(F.col("conv_id").alias("conv"), F.col("by").alias("speaker")).distinct()
    role = F.when(F.col("by") == F.col("speaker"), "assistant").when(F.coalesce(F.col("by"), F.lit("system")) == "system", "system").otherwise("user")
    name = F.when(role == "user", F.col("by"))
    # speakers by block, so that a conversation of very many turns is dealt over its blocks
    blocks = said.select(F.col("conv_id").alias("c"), F.col("block").alias("blk")).distinct()
    asked = blocks.join(speakers, F.col("c").eqNullSafe(F.col("conv"))).select("conv", "blk", "speaker")
    rows = said.join(asked, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("blk"))).drop("conv", "blk").withColumn("role", role).withColumn("name", name)
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), broken(F.regexp_replace("name", r"[\x00-\x1F\x7F]", " "))), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("rendered", F.concat(head, "content", F.lit(CLOSE + "\n"))).withColumn("size", F.length("rendered").cast("long")).withColumn("head", F.length(head))
    blocks = rows.groupBy("conv_id", "speaker", "block").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(W.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(W.partitionBy("conv_id", "speaker", "block").orderBy("turn", "by", "content").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b")))
    start = F.col("before") + F.col("inside")
    own = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "speaker", "turn", "role", "name", "rendered", start.alias("start"),
        F.when(own, start + F.col("head")).otherwise(start).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).otherwise(start).alias("mask_end"),
    )


def assembled(segments: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(conv_id, speaker, part, rendered, masks): the segments joined to texts of about ``size`` characters.

    masks: array<struct<start, end>> in characters of the part. Segments stay whole.
    """
    part = F.floor(F.col("start") / size)
    got = segments.groupBy("conv_id", "speaker", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_end"))).alias("s"))
    first = F.element_at("s", 1)["start"]
    masks = F.transform(F.filter("s", lambda x: x["mask_end"] > x["mask_start"]), lambda x: F.struct((x["mask_start"] - first).alias("start"), (x["mask_end"] - first).alias("end")))
    return got.select("conv_id", "speaker", "part", F.array_join(F.transform("s", lambda x: x["rendered"]), "").alias("rendered"), masks.alias("masks"))


def op9_chat_rotation(spark, sf_dir: str) -> DataFrame:
    """Every segment of every participant's rendering of all conversations."""
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role AS who,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS content
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, who AS speaker FROM said WHERE who IS NOT NULL AND who <> 'system'
), parts AS (
  SELECT s.conv_id, p.speaker, s.turn, s.who, s.content,
         CASE WHEN s.who = p.speaker THEN 'assistant' WHEN coalesce(s.who, 'system') = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN who END AS name,
         '<|im_start|>' || role || coalesce(CASE WHEN role = 'user' THEN ' name=' || replace(replace(regexp_replace(who, '[\x00-\x1F\x7F]', ' ', 'g'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') END, '') || chr(10) AS head
  FROM parts
), sized AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM named
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (
      PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who NULLS FIRST, content
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sized
)
SELECT conv_id, speaker, turn, role, name, rendered, CAST(begins AS BIGINT) AS start,
       CAST(CASE WHEN role = 'assistant' THEN begins + length(head) ELSE begins END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN begins + length(rendered) - 1 ELSE begins END AS BIGINT) AS mask_end
FROM placed
"""
