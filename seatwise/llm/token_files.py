"""Documents tokenized into range-coded token-id files (``token_coder``) and read back.

Documents are range-partitioned by id, so files and frames are in ascending id order (null ids first,
rows with equal ids in any order). A task writes one file under a name of its own; the frames table
lists the frames of the tasks that Spark committed, so files of failed attempts are never read.
A null text is empty, an empty text has the end id alone, an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import new_folder, open_store, stored, whole_text
from seatwise.llm.piece_cache import library_encoder
from seatwise.llm.token_coder import BLOCK, LANES, frame, read_frame

FRAME_IDS = BLOCK * LANES
FRAMES = "part int, frame int, path string, at long, size long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Writes ``docs`` below ``folder``; returns the stored table of frames."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, True)
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        out, at, frames, doc_ids, ids, held = None, 0, [], [], [], 0

        def flush() -> None:
            nonlocal out, at, doc_ids, ids, held
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path)
            data = frame(doc_ids, ids, vocabulary)
            out.write(data)
            frames.append((part, len(frames), path, at, len(data), held))
            at, doc_ids, ids, held = at + len(data), [], [], 0

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
                doc_ids.append(doc)
                ids.append(found + end)
                held += len(found) // 4 + 1
                if held >= FRAME_IDS:
                    flush()
        if doc_ids:
            flush()
        if out is not None:
            out.close()
            names = ["part", "frame", "path", "at", "size", "n_ids"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*frames), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    return stored(ordered.mapInArrow(write, FRAMES), "token-frames")


def read_token_files(spark: SparkSession, frames: DataFrame, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32.

    Starts are prefix sums: of the totals of the parts, of the frames in a part, of the documents in a
    frame. Damaged blocks raise an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    file.seek(row["at"])
                    doc_ids, lengths, ids = read_frame(file.read(row["size"]))
                data, start, starts, sums = memoryview(ids.tobytes()), 0, [], []
                for n in lengths:
                    starts.append(row["start"] + start)
                    sums.append(zlib.crc32(data[4 * start : 4 * (start + n)]))
                    start += n
                columns = [pa.array(c, pa.int64()) for c in (doc_ids, starts, lengths, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = W.rowsBetween(W.unboundedPreceding, -1)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("held"))
    starts = parts.select("part", F.sum("held").over(before.orderBy("part")).alias("part_start"))
    own = F.sum("n_ids").over(before.partitionBy("part").orderBy("frame"))
    start = F.coalesce("part_start", F.lit(0)) + F.coalesce("own_start", F.lit(0))
    placed = frames.withColumn("own_start", own).join(starts, "part")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        placed.select("path", "at", "size", start.alias("start"))
        .repartition(tasks)
        .mapInArrow(read, DOCUMENTS)
    )


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257) -> DataFrame:
    """Writes token files in a new shared folder and returns what ``read_token_files`` finds there."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    frames = write_token_files(docs, folder, tokenizer, end_id, vocabulary)
    return read_token_files(spark, frames, folder)
