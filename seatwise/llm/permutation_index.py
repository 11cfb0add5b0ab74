"""Nearest neighbours by largest inner product with a permutation index.

A vector is represented by the order of ``PIVOTS`` pivots by nearness. It is posted in the inverted files
of its ``POSTED`` nearest pivots; a query gathers what is posted under its own nearest pivots, keeps what
is within ``cutoff`` in footrule distance of the two orders, and ranks that by the exact inner product.
Pivots and cutoff come from a sample of at most ``SAMPLE`` vectors: the cutoff covers ``COVERED`` of the
sample's true neighbours, and there is no cap on postings or candidates. A query that finds fewer than
``k`` in a block of the index takes the whole block, so small tables are searched exactly.

So that long vectors count as near, each vector gets one more component that makes all lengths equal, and
queries, brought to that length, a zero. The index is kept in blocks of about ``BLOCK`` vectors, each with
its own inverted files; blocks of queries meet blocks of the index.

Vectors that are null, zero, of another dimension than most, or that hold a null or non-finite component,
and rows with a null id, take no part. Rows with the query's id are its own; of rows that repeat a query's
id one is searched for. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import stored

PIVOTS = 128
POSTED = 14
SAMPLE = 4000
COVERED = 0.97
BLOCK = 16_384
QUERIES = 512
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Pivots:
    vectors: np.ndarray  # with the added component
    length: float
    cutoff: int

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.length**2 - (x * x).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def as_queries(self, x: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.column_stack([x * (self.length / norms), np.zeros(len(x))])

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """The place of each pivot in the order of each vector."""
        order = np.argsort(-(x @ self.vectors.T), axis=1, kind="stable")
        places = np.empty(order.shape, np.uint8)
        np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.uint8)[None], axis=1)
        return places


def footrule(ranks: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.abs(ranks.astype(np.int16) - own.astype(np.int16)).sum(axis=1, dtype=np.int32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec: Column = F.col("vec")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")
    ).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(vec, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["size"] if sizes else 0))


def choose_pivots(rows: DataFrame, k: int, seed: int = 7) -> Pivots | None:
    length = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    if length is None:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.array([r["vec"] for r in drawn])
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    pivots = Pivots(np.zeros((0, 0)), float(np.sqrt(length)), 0)
    chosen = rng.permutation(len(distinct))[:PIVOTS]
    pivots.vectors = pivots.lengthened(distinct[chosen])
    tried = sample[:: max(1, len(sample) // 200)]
    ranks, own = pivots.ranks(pivots.lengthened(sample)), pivots.ranks(pivots.as_queries(tried))
    near = np.argsort(-(tried @ sample.T), axis=1)[:, 1 : k + 1]
    apart = np.concatenate([footrule(ranks[n], o) for n, o in zip(near, own)] or [np.zeros(1)])
    pivots.cutoff = int(np.quantile(apart, COVERED)) if len(apart) else 0
    return pivots


def build_index(rows: DataFrame, pivots) -> DataFrame:
    """The stored index: every vector with its ranks and block."""
    blocks = max(1, -(-rows.count() // BLOCK))

    @F.pandas_udf("binary")
    def ranked(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist())
        found = pivots.value.ranks(pivots.value.lengthened(x)) if len(x) else []
        return pd.Series([r.tobytes() for r in found], dtype=object)

    block = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")
    return stored(rows.select("vec_id", "vec", ranked("vec").alias("ranks"), block.alias("block")), "permutations")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query`` of ``vec_id``."""
    rows = usable(vectors, id_col, vector_col)
    chosen = choose_pivots(rows, k)
    if chosen is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = rows.sparkSession.sparkContext.broadcast(chosen)
    index = build_index(rows, pivots)
    queries = index.where(is_query).dropDuplicates(["vec_id"])
    blocks = index.agg(F.max("block")).first()[0] + 1
    groups = max(1, -(-queries.count() // QUERIES))
    asked = queries.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    searched = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """One block of the index, one group of queries."""
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        pivots_ = pivots.value
        ids, x = one["vec_id"].to_numpy(), np.array(one["vec"].tolist())
        ranks = np.frombuffer(b"".join(one["ranks"]), np.uint8).reshape(len(one), -1)
        member, pivot = np.nonzero(ranks < POSTED)
        order = np.argsort(pivot, kind="stable")
        ends = np.cumsum(np.bincount(pivot, minlength=ranks.shape[1]))
        files = np.split(member[order], ends[:-1])
        asked_x = np.array(two["vec"].tolist())
        places = pivots_.ranks(pivots_.as_queries(asked_x))
        found = []
        for query, vector, place in zip(two["vec_id"].tolist(), asked_x, places):
            posted = np.zeros(len(ids), bool)
            for p in np.flatnonzero(place < POSTED):
                posted[files[p]] = True
            posted &= ids != query
            near = np.flatnonzero(posted)
            near = near[footrule(ranks[near], place) <= pivots_.cutoff]
            if len(near) < k:
                near = np.flatnonzero(ids != query)
            score = (x[near] * vector).sum(axis=1)
            if len(score) > k:
                enough = score >= np.partition(score, -k)[-k]
                near, score = near[enough], score[enough]
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(best), query), ids[near[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns)))

    pairs = searched.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
