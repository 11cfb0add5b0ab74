"""Packing by concatenation and cuts: documents laid end to end, cut into windows of fixed length.

First pass: tasks tokenize their partitions and store the ids, each document in rows of at most
``CHUNK`` ids with its place in the partition. The prefix sum over the partitions' token totals gives
every row its global offset. Second pass, in DataFrame operations: a boundary record wherever a
multiple of the sequence length falls into a row cuts it into pieces. All sequences but the last are full.

A null or empty text is one end id. Rows with equal or null ids are documents of their own. An empty
table gives no piece. Which documents share a sequence depends on the partitions, not on the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import stored, whole_text
from seatwise.llm.piece_cache import library_encoder

SEQUENCE = 4096
CHUNK = 16 * SEQUENCE  # ids in a stored row, so that a cut never copies a very long document
ROWS = "doc_id long, doc_tokens long, part int, place long, start long, n_ids long, ids binary"


def tokenized(
    docs: DataFrame, tokenizer: str, end_id: int, spaced: bool, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Stored rows of ids: document, its ids in all, partition, place in it, ids of the document before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(tokenizer, spaced), end_id.to_bytes(4, "little")
        part, place, rows, held = TaskContext.get().partitionId(), 0, [], 0
        schema = pa.schema(
            [("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64()),
             ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())]
        )
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
                found += end
                total = len(found) // 4
                for start in range(0, total, CHUNK):
                    ids = found[4 * start : 4 * (start + CHUNK)]
                    rows.append((doc, total, part, place + start, start, len(ids) // 4, ids))
                    held += len(ids)
                place += total
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return stored(texts.mapInArrow(run, ROWS), "token-rows")


def pack(rows: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """The pieces of ``tokenized`` rows in sequences of ``length`` ids."""
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("part_start"))
    # a row for each task of one stage: less than the driver itself holds for such a task
    placed = rows.join(F.broadcast(starts), "part").withColumn("first", F.col("part_start") + F.col("place"))
    last = F.col("first") + F.col("n_ids") - 1
    cut = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.expr(f"first div {length}"), F.floor(last / length)))
    )
    begin = F.greatest(F.col("sequence_id") * length - F.col("first"), F.lit(0))
    end = F.least((F.col("sequence_id") + 1) * length - F.col("first"), F.col("n_ids"))
    cut = cut.withColumn("begin", begin).withColumn("length", end - begin)
    own = F.substring("ids", (4 * F.col("begin") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return cut.select(
        "doc_id",
        (F.col("start") + F.col("begin")).alias("start"),
        "length",
        F.crc32(own).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        (F.col("first") + F.col("begin") - F.col("sequence_id") * length).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, length: int = SEQUENCE
) -> DataFrame:
    return pack(tokenized(docs, tokenizer, end_id, spaced), length)
