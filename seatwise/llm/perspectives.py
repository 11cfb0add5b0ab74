"""Chat formatting by perspective rotation, in DataFrame operations only.

Each speaker of a conversation in turn becomes the assistant; every other speaker is a user with a
name, system turns stay system turns. The loss mask of a perspective covers what its own speaker says,
with the end mark. Conversations of any length are rendered in blocks of ``BLOCK`` turns, whose texts
joined in block order are the whole dialogue; turns are numbered by sorted ranges and offsets, so a huge
conversation is spread over many tasks.

Turns are ordered by (turn, role, SHA-256 of the text), nulls first; repeated rows are turns of their
own. A null text is empty, a null role is the speaker ``unknown``, a null conversation id is one
conversation. A conversation with system turns alone has no perspective and no row. Other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import stored, whole_text

BLOCK = 256
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored turns with their place in the conversation, from 0, and their block."""
    order = ["conv_id", "turn", "role", "sha"]
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        whole_text().alias("text"),
    ).withColumn("sha", F.sha2("text", 256))
    # the random last key lets even a row that is repeated very often fall into several ranges
    ranged = (
        rows.withColumn("spread", F.rand(7))
        .repartitionByRange(*order, "spread")
        .sortWithinPartitions(*order)
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
        .select("conv_id", "role", "text", "number", "part")
    )
    ranged = stored(ranged, "turns")
    runs = ranged.groupBy("conv_id", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("run_conv"),
        F.col("part").alias("run_part"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = ranged["conv_id"].eqNullSafe(runs["run_conv"]) & (ranged["part"] == runs["run_part"])
    place = (F.col("number") + F.col("shift")).alias("place")
    placed = ranged.join(runs, same).select("conv_id", "role", "text", place)
    return placed.withColumn("block", F.expr(f"place div {block}"))


def _opening(role: Column, speaker: Column) -> Column:
    return F.concat(
        F.lit(START),
        F.when(role == SYSTEM, F.lit(SYSTEM))
        .when(role == speaker, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), role)),
        F.lit("\n"),
    )


def rotate_perspectives(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per (conversation, speaker, block): conv_id, perspective, block, n_turns, text, mask.

    ``mask`` lists (begin, end) in characters of the block's text, in order.
    """
    placed = numbered(turns, block)
    blocks = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    speakers = (
        placed.where(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("speaker_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    pairs = blocks.join(speakers, blocks["conv_id"].eqNullSafe(speakers["speaker_conv"]))
    speaker = F.col("perspective")
    opened = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(_opening(t["role"], speaker)).alias("opening"),
            (F.length(t["text"]) + len(END)).alias("content"),
            (t["role"] == speaker).alias("own"),
            F.concat(_opening(t["role"], speaker), t["text"], F.lit(END + "\n")).alias("said"),
        ),
    )
    length = lambda t: t["opening"] + t["content"] + 1
    start = lambda k: F.aggregate(
        F.slice("said", 1, k), F.lit(0), lambda held, t: held + length(t)
    )
    spans = F.transform(
        "said",
        lambda t, k: F.when(
            t["own"],
            F.struct(
                (start(k) + t["opening"]).alias("begin"),
                (start(k) + t["opening"] + t["content"]).alias("end"),
            ),
        ),
    )
    return pairs.withColumn("said", opened).select(
        "conv_id",
        "perspective",
        "block",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: t["said"]), "").alias("text"),
        F.filter(spans, lambda s: s.isNotNull()).alias("mask"),
    )


def digests(rendered: DataFrame) -> DataFrame:
    covered = F.aggregate("mask", F.lit(0), lambda held, s: held + s["end"] - s["begin"])
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["begin"], s["end"]))
    return rendered.select(
        "conv_id",
        "perspective",
        "block",
        "n_turns",
        F.length("text").cast("long").alias("n_chars"),
        covered.cast("long").alias("mask_chars"),
        F.array_join(spans, ",").alias("mask_spans"),
        F.sha2("text", 256).alias("text_sha256"),
    )
