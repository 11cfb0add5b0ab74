"""Registered queries of this folder, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import periodic_runs, perspectives, prefix_bpe, turn_repair
from seatwise.llm.common import new_folder, table
from seatwise.llm.cover_tree import top_matches
from seatwise.llm.exact_dedup import exact_duplicates
from seatwise.llm.language_cnn import identify_languages
from seatwise.llm.packing import pack_documents
from seatwise.llm.permutation_index import nearest
from seatwise.llm.suffix_dedup import repeated_passages
from seatwise.llm.token_files import token_file_round_trip
from seatwise.llm.weighted_minhash import near_duplicate_classes
from seatwise.llm.warc import archived_pages, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
        doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return archived_pages(spark, folder)


# base 32 from the hexadecimal digits of the hash, five bits at a time
ORACLES["op2_warc"] = """
    WITH hashed AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
            [instr('0123456789abcdef', substr(sha1(coalesce(html, '')), n + 1, 1)) - 1 FOR n IN range(40)] AS digits,
            max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep_id
        FROM pages)
    SELECT page_id, payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (((digits[1 + k * 5 // 4] * 16 + digits[2 + k * 5 // 4]) >> (3 - k * 5 % 4)) & 31), 1)
            FOR k IN range(32)], '') AS payload_digest,
        CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to
    FROM hashed"""


@query
def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digests(perspectives.rotate_perspectives(table(spark, sf_dir, "conversations")))


ORACLES["op5_perspectives"] = f"""
    WITH placed AS (
        SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                coalesce(role, 'unknown'), sha256(coalesce(text, ''))) - 1 AS place
        FROM conversations),
    speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM placed WHERE role <> 'system'),
    opened AS (
        SELECT p.*, perspective, place // {perspectives.BLOCK} AS block, role = perspective AS own,
            '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective
                THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS opening
        FROM placed p JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
    said AS (
        SELECT *, opening || text || '<|im_end|>' || chr(10) AS said,
            length(text) + 10 AS content,
            sum(length(opening) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, block
                ORDER BY place) - length(text) - 11 AS begin
        FROM opened)
    SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, count(*) AS n_turns,
        CAST(length(string_agg(said, '' ORDER BY place)) AS BIGINT) AS n_chars,
        CAST(sum(CASE WHEN own THEN content ELSE 0 END) AS BIGINT) AS mask_chars,
        coalesce(string_agg(CAST(CAST(begin AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin + content AS BIGINT)
            AS VARCHAR), ',' ORDER BY place) FILTER (own), '') AS mask_spans,
        sha256(string_agg(said, '' ORDER BY place)) AS text_sha256
    FROM said GROUP BY conv_id, perspective, block"""


@query
def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = prefix_bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return prefix_bpe.digests(encoded)


@query
def op7_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


@query
def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", whole)
    found = top_matches(vectors, F.col("vec_id") % 50 == 0, k=5)
    return found.withColumn("score", F.col("score").cast("long"))


ORACLES["op13_cover_tree"] = """
    WITH usable AS (
        SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec FROM embeddings
        WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec) AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, CAST(score AS BIGINT) AS score FROM scored)
    SELECT * FROM ranked WHERE rank <= 5"""


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_repair.with_damage(table(spark, sf_dir, "conversations"))
    return turn_repair.repair_conversations(turns, copies_col="copies")
