"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

The directory has a slot for each value of the leading bits of a hash. It starts with ``BITS`` bits and doubles
until no slot is overfull, so it has as many slots as the texts need. A bucket starts as the whole directory and
is halved, one bit more at a time, while it holds more than ``capacity`` hashes, so that slots of one bucket
share a prefix. Copies of a text are folded into one entry before any shuffle. Each owner task gets a
range of (bucket, hash), stores its entries in that order, and chains those of one hash whose bytes differ.
A row finds its bucket through the directory and its entry in the bucket, by hash and chained text.

Nulls: a null text counts as empty, a null id never stays unless its text has no other id. Rows that
share the id that stays all stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import stored, whole_text

BITS = 8  # of the first directory
CAPACITY = 250_000  # hashes of a bucket before it is split


@dataclass
class HashIndex:
    """``directory``: slot, depth, bucket. ``entries``: bucket, hash, chain, sha256, keep_id, group_size."""

    bits: int
    directory: DataFrame
    entries: DataFrame


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return named.withColumn("hash", F.xxhash64("text"))


def _slot(bits: int) -> Column:
    """The leading bits of a hash as a number."""
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Its bits, and (slot, depth, bucket): ``depth`` leading bits lead to the bucket of a slot.

    While a slot holds more than ``capacity`` of the distinct ``hash`` values, the directory doubles, as often
    as that slot needs at least. The depth of a slot is the least at which the bucket around it holds
    ``capacity`` or fewer. The driver sees the count of the fullest slot alone.
    """
    distinct = stored(hashes.select("hash").distinct(), "hashes")
    bits = BITS
    while True:
        slots = distinct.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("held"))
        fullest = slots.agg(F.max("held")).first()[0] or 0
        if fullest <= capacity or bits == 63:
            break
        bits = min(63, bits + max(1, ceil(log2(fullest / capacity))))
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    halved = slots.select("slot", "held", depths).withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    total = halved.groupBy("depth", "prefix").agg(F.sum("held").alias("held"))
    fitting = total.where((F.col("held") <= capacity) | (F.col("depth") == bits)).drop("held")
    found = halved.join(fitting, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    bucket = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    return bits, stored(found.withColumn("bucket", bucket), "hash-directory")


def _in_buckets(hashed: DataFrame, bits: int, slots: DataFrame) -> DataFrame:
    return hashed.withColumn("slot", _slot(bits)).join(slots.select("slot", "bucket"), "slot").drop("slot")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> HashIndex:
    """The stored index, an entry per distinct text.

    Grouping by the text compares whole texts byte by byte, after copies in a task are folded. Chains are
    numbered by the owner of their range, without another shuffle.
    """
    hashed = _hashed(docs, id_col, text_col)
    bits, slots = directory(hashed, capacity)
    groups = (
        _in_buckets(hashed, bits, slots)
        .groupBy("bucket", "hash", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .withColumn("sha256", F.unhex(F.sha2("text", 256)))
        .drop("text")
    )
    chain = F.row_number().over(W.partitionBy("bucket", "hash").orderBy("sha256"))
    owned = groups.repartitionByRange("bucket", "hash").withColumn("chain", chain)
    return HashIndex(bits, slots, stored(owned, "hash-index"))


def look_up(rows: DataFrame, index: HashIndex) -> DataFrame:
    """``rows`` (hash, sha256, any others) with keep_id and group_size of their entries."""
    entries = index.entries.select("bucket", "hash", "sha256", "keep_id", "group_size")
    return _in_buckets(rows, index.bits, index.directory).join(entries, ["bucket", "hash", "sha256"])


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, capacity)
    rows = _hashed(docs, id_col, text_col).select(
        "doc_id", "hash", F.unhex(F.sha2("text", 256)).alias("sha256")
    )
    return look_up(rows, index).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no copy with a larger id."""
    gone = (
        exact_duplicates(docs, id_col, text_col)
        .where(~F.col("kept"))
        .select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text"))
    )
    same_text = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["gone_text"]
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & same_text, "left_anti")
