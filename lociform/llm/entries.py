"""The subpackage's queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociform.llm import chat, embed_dedup, licenses, media, mixing, near_dedup, pii, quality, sentence_pieces, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_pii": pii.op2_pii,
        "op3_quality": quality.op3_quality,
        "op4_media": media.op4_media,
        "op5_embed_dedup": embed_dedup.op5_embed_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_licenses": licenses.op7_licenses,
        "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
        "op9_chat_rotation": chat.op9_chat_rotation,
        "op10_warc_revisits": warc.op10_warc_revisits,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op9_chat_rotation": chat.SQL, "op10_warc_revisits": warc.SQL}
