"""Operator 5: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once, with
that participant as ``assistant`` and every other one as a user of that name;
the mask holds the character spans of the participant's own words.  System
messages are shown as such in every perspective and are no participant.

A conversation is rendered in blocks of at most ``BLOCK_TURNS`` messages
(most have one block), so a conversation with very many turns is never one
row or one task's group.  Blocks follow the turn numbers; within a block,
messages are ordered by turn, speaker and text.  Turn numbers bound a block
unless they are repeated or null; blocks of more than ``WINDOW_ROWS`` messages
are numbered over sorted ranges instead of in one window.

Cases: a null speaker is called ``unknown``; a null text is empty; a null turn
comes after all others; repeated turns are rendered a time each; a
conversation with system messages only has no perspective; a null conv_id is a
conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, hint_small

BLOCK_TURNS = 64
WINDOW_ROWS = 4096
SYSTEM, UNKNOWN = "system", "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _order() -> list:
    return [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]


def _same_block() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & F.col("block").eqNullSafe(F.col("of_block"))


def _by_size(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of blocks that a window can number, and those of larger blocks (at most one in WINDOW_ROWS messages is such a block)."""
    checkpoint_folder(messages.sparkSession)
    large = messages.groupBy("conv_id", "block").count().where(F.col("count") > WINDOW_ROWS).select(F.col("conv_id").alias("of_conv_id"), F.col("block").alias("of_block")).checkpoint()
    large = hint_small(large)
    return messages.join(large, _same_block(), "left_anti"), messages.join(large, _same_block(), "left_semi")


def _numbered_by_range(messages: DataFrame) -> DataFrame:
    """Messages numbered from 1 in their block: in sorted ranges of all messages, after the block's messages in the ranges before.

    Equal messages are told apart by the row they were read from, so ranges
    are even whatever repeats.  A range begins inside one block at most: that
    bounds the broadcast offsets by the number of ranges.
    """
    late = F.col("turn").isNull()
    dealt = messages.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", "block", late, "turn", "speaker", "text", "row")
    dealt = dealt.withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("conv_id", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("conv_id", "block", "range").count().select(F.col("conv_id").alias("of_conv_id"), F.col("block").alias("of_block"), F.col("range").alias("of_range"), F.sum("count").over(before).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block", "range").orderBy(*_order(), "row"))
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(offsets.where("offset > 0")), _same_block() & (F.col("range") == F.col("of_range")), "left")
    return numbered.select("conv_id", "turn", "speaker", "text", "block", (F.col("inside") + F.coalesce("offset", F.lit(0))).alias("number"))


def _parts(numbered: DataFrame) -> DataFrame:
    parts = numbered.withColumn("part", F.floor((F.col("number") - 1) / BLOCK_TURNS))
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", "speaker", "text")
    return parts.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, block, part, perspective, n_turns, rendered and mask (array of from, to) of every block and participant."""
    messages = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    who = messages.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("who_id"), F.col("speaker").alias("perspective")).distinct()
    small, large = _by_size(messages)
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*_order()))
    blocks = _parts(small.withColumn("number", inside)).unionByName(_parts(_numbered_by_range(large)))
    seen = blocks.join(who, F.col("conv_id").eqNullSafe(F.col("who_id"))).drop("who_id")
    own = lambda m: m["speaker"] == F.col("perspective")
    head = lambda m: F.concat(F.lit(BEGIN), F.when(own(m), F.lit("assistant")).when(m["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), m["speaker"])), F.lit("\n"))
    parts = F.transform("messages", lambda m: F.struct(head(m).alias("head"), m["text"].alias("text"), own(m).alias("own")))
    seen = seen.withColumn("parts", parts)
    rendered = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["text"]) + len(END)).alias("at"),
            F.when(p["own"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("from"), (s["at"] + F.length(p["head"]) + F.length(p["text"])).alias("to"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return seen.select("conv_id", "block", "part", "perspective", F.size("messages").cast("long").alias("n_turns"), rendered.alias("rendered"), spans.alias("mask"))


def digest(rotated: DataFrame) -> DataFrame:
    """The rendering's length, digest and mask as text."""
    mask = F.array_join(F.transform("mask", lambda s: F.concat(s["from"], F.lit("-"), s["to"])), ",")
    masked = F.aggregate("mask", F.lit(0), lambda n, s: n + s["to"] - s["from"]).cast("long")
    return rotated.select("conv_id", "block", "part", "perspective", "n_turns", F.length("rendered").cast("long").alias("n_chars"), masked.alias("n_masked"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"), mask.alias("mask"))


DIGEST_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, CAST(floor(turn / 64) AS BIGINT) AS block FROM conversations),
n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS LAST, speaker, text) - 1) / 64) AS BIGINT) AS part FROM m),
w AS (SELECT DISTINCT conv_id AS who_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
p AS (SELECT n.*, perspective, speaker = perspective AS own,
        '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
      FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.who_id),
q AS (SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, block, part, perspective ORDER BY turn NULLS LAST, speaker, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) - 11 AS a FROM p)
SELECT conv_id, block, part, perspective, count(*) AS n_turns, CAST(sum(length(head) + length(text) + 11) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS n_masked,
  sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, speaker, text)) AS rendered_sha256,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS LAST, speaker, text) FILTER (own), '') AS mask
FROM q GROUP BY conv_id, block, part, perspective
"""
