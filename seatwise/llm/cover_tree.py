"""Exact top-k search by largest inner product with cover trees over data and queries.

Queries are rows of the same table, so both are indexed by one tree. Its top level is a net: the first points
of a farthest-first order of a sample of at most ``SAMPLE`` rows, at most ``CENTRES`` of them. Every row
belongs to the node of its nearest centre. Nodes that hold more than ``SHARD`` rows are dealt over shards, so
a vector that repeats in a third of all rows fills no task. Below that, each task builds a cover tree over
its shard and one over each group of queries, where children are a net of about half their parent's radius.

A pair of nodes is left out if no product of the two balls, by centres, covering radii and norms, can reach
the worst k-th score of the queries in it. Each query first searches one shard of its own node; the k-th
score found there prunes the top nodes it is sent to and everything below. Index rows are shuffled once
for each of the two passes, and only queries are copied, to the nodes that may hold better rows.

Scores are double precision sums, so exact for integer components while they stay below 2^53. Vectors that are
null or hold a null or non-finite component, and rows with a null id, take no part. A shorter vector counts as
continued by zeros; an empty one scores 0. Rows with the query's id are its own. Each row is a
query of its own, also where ids repeat, and repeated rows are candidates of their own. Ties go to the smaller id. No
rows give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import stored

SAMPLE = 4096
CENTRES = 256
SHARD = 8192
LEAF = 128
CHILDREN = 64
QUERIES = 2048  # of a group that is searched together
SHRINK = 0.9  # a cover that stays wider than this share of its parent's radius is no cover
FOUND = "query_row long, query_id long, vec_id long, score double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, continued by zeros to the longest of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return values.reshape(len(sizes), wide)
    found = np.zeros((len(sizes), wide))
    found[np.arange(wide) < sizes[:, None]] = values
    return found


def product(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    wide = min(one.shape[1], other.shape[1])
    return one[:, :wide] @ other[:, :wide].T


def farthest_first(x: np.ndarray, most: int, enough: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A net that starts at row 0: its rows, each row's member of it, and each row's distance to that."""
    net, owner = [0], np.zeros(len(x), np.int64)
    apart = np.linalg.norm(x - x[0], axis=1)
    while len(net) < most and apart.max() > enough:
        far = int(apart.argmax())
        new = np.linalg.norm(x - x[far], axis=1)
        closer = new < apart
        owner[closer] = len(net)
        apart[closer] = new[closer]
        net.append(far)
    return net, owner, apart


@dataclass
class Node:
    """A ball around the vector of its first row. Only leaves keep the numbers of all their rows."""

    rows: np.ndarray
    centre: np.ndarray
    length: float  # of the centre
    radius: float
    longest: float  # of the rows
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    apart = np.linalg.norm(own - own[0], axis=1)
    norms = np.linalg.norm(own, axis=1)
    node = Node(rows, own[0], float(norms[0]), float(apart.max()), float(norms.max()))
    if len(rows) > LEAF and node.radius > 0:
        net, owner, left = farthest_first(own, CHILDREN, node.radius / 2)
        if left.max() <= SHRINK * node.radius:
            for k, first in enumerate(net):
                mine = np.flatnonzero(owner == k)
                mine = np.concatenate([[first], mine[mine != first]])  # a parent's point is that of its first child
                node.children.append(cover_tree(x, rows[mine]))
            node.rows = rows[:0]
    return node


def highest(query: Node, data: Node) -> float:
    """No product of a vector of each ball is greater, rounding included."""
    wide = min(len(query.centre), len(data.centre))
    middle = float(query.centre[:wide] @ data.centre[:wide])
    by_balls = middle + data.radius * query.length + query.radius * data.length + query.radius * data.radius
    size = query.longest * data.longest
    return min(by_balls, size) + 1e-9 * (abs(middle) + size) + 1e-9


class Search:
    """The best ``k`` of one shard for a group of queries. Scores below a query's floor are not looked for."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.x, self.own, self.k, self.floor = queries, own, k, floor
        self.score = np.full((len(own), k), -np.inf)
        self.id = np.full((len(own), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def compare(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """All pairs of two leaves, by one matrix product."""
        scores = product(self.x[rows], x)
        scores[self.own[rows][:, None] == ids] = -np.inf
        least = self.worst(rows)
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        which, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(which):
            return
        changed = np.unique(which)
        held = np.repeat(changed, self.k)
        query = np.concatenate([held, which])
        score = np.concatenate([self.score[rows[changed]].ravel(), scores[which, at]])
        vec = np.concatenate([self.id[rows[changed]].ravel(), ids[at]])
        order = np.lexsort((vec, -score, query))
        first = np.searchsorted(query[order], changed)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[rows[changed]], self.id[rows[changed]] = score[best], vec[best]

    def visit(self, query: Node, data: Node, x: np.ndarray, ids: np.ndarray, least) -> None:
        """Both trees at once: nearest pairs of nodes first, pairs that can't help left out."""
        if highest(query, data) < least(query):
            return
        if not query.children and not data.children:
            self.compare(query.rows, x[data.rows], ids[data.rows])
        elif data.children and (not query.children or data.radius >= query.radius):
            for child in sorted(data.children, key=lambda c: -highest(query, c)):
                self.visit(query, child, x, ids, least)
        else:
            for child in query.children:
                self.visit(child, data, x, ids, least)

    def run(self, tree: Node, x: np.ndarray, ids: np.ndarray) -> None:
        def least(node: Node) -> float:
            if node.children:
                return min(least(c) for c in node.children)
            return float(self.worst(node.rows).min())

        self.visit(cover_tree(self.x), tree, x, ids, least)


def few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among anyone's ``k`` best: of equal vectors, ``k`` rows of each of the ``k`` + 1 least ids."""
    _, same = np.unique(x, axis=0, return_inverse=True) if x.shape[1] else (None, np.zeros(len(x), np.int64))
    order = np.lexsort((ids, same.ravel()))
    vec, own = same.ravel()[order], ids[order]
    new_vec = np.append(True, vec[1:] != vec[:-1])
    new_id = new_vec | np.append(True, own[1:] != own[:-1])
    start = np.maximum.accumulate(np.where(new_id, np.arange(len(own)), 0))
    nth_id = np.cumsum(new_id) - np.cumsum(new_id)[np.maximum.accumulate(np.where(new_vec, np.arange(len(own)), 0))]
    return np.sort(order[(np.arange(len(own)) - start < k) & (nth_id <= k)])


def _searched(k: int):
    """Streams shards: the rows of the index come first, then the queries, in groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree, x, ids, asked = None, [], None, None, None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, x, ids, asked, parts
            if not asked:
                return
            if tree is None and parts:
                x, ids = matrix(pa.chunked_array([p["vec"] for p in parts])), np.concatenate([p["vec_id"].to_numpy() for p in parts])
                kept = few_copies(x, ids, k)
                x, ids = x[kept], ids[kept]
                tree, parts = cover_tree(x), []
            group, asked = pa.Table.from_batches(asked), []
            if tree is None:
                return
            for start in range(0, len(group), QUERIES):
                some = group.slice(start, QUERIES)
                own = some["vec_id"].to_numpy()
                search = Search(matrix(some["vec"]), own, some["least"].to_numpy(), k)
                search.run(tree, x, ids)
                which, at = np.nonzero(search.score > -np.inf)
                columns = [some["row"].to_numpy()[which], own[which], search.id[which, at], search.score[which, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in ("centre", "salt", "kind")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for start, end in zip(cuts, [*cuts[1:], len(batch)]):
                centre, salt, kind = keys[start].tolist()
                if (centre, salt) != key:
                    yield from answers()
                    key, parts, tree = (centre, salt), [], None
                part = batch.slice(start, end - start)
                if kind == 0:
                    parts.append(part)
                else:
                    asked.append(part)
                    if sum(map(len, asked)) >= QUERIES:
                        yield from answers()
        yield from answers()

    return run


def top_matches(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each row where ``is_query`` of ``vec_id``."""
    spark, vec = vectors.sparkSession, F.col("vec")
    usable = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")
    ).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    usable = usable.where(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = stored(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").toArrow()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(drawn["vec"])
    net = sample[farthest_first(sample, min(CENTRES, -(-total // SHARD)))[0]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (net * net).sum(axis=1) / 2
        for batch in batches:
            x = matrix(batch.column("vec"))
            centre = (product(x, net) - half).argmax(axis=1)
            wide = min(x.shape[1], net.shape[1])
            apart = (x * x).sum(axis=1) + 2 * half[centre] - 2 * (x[:, :wide] * net[centre, :wide]).sum(axis=1)
            extra = [pa.array(centre, pa.int32()), pa.array(np.sqrt(np.maximum(apart, 0)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "centre", "apart"])

    placed = rows.mapInArrow(assign, "vec_id long, vec array<double>, row long, centre int, apart double")
    index = stored(placed, "cover-index")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    # a row for each of at most CENTRES nodes
    nodes = index.groupBy("centre").agg(
        F.count("*").alias("n"), F.max("apart").alias("radius"), F.max(length).alias("longest")
    )
    known = {r["centre"]: r for r in nodes.collect()}
    salts = F.element_at(
        F.create_map(*[F.lit(v) for c, r in known.items() for v in (c, -(-r["n"] // SHARD))]), F.col("centre")
    )
    data = index.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    asked = index.where(is_query)
    plain = ["centre", "salt", "kind", "home", "vec_id", "vec", "row", "least"]
    data = data.selectExpr("centre", "salt", "0 AS kind", "0 AS home", "vec_id", "vec", "row", "CAST(0 AS DOUBLE) AS least")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total // SHARD, 10_000))

    def search(queries: DataFrame) -> DataFrame:
        both = data.unionByName(queries.select(*plain)).repartition(tasks, "centre", "salt")
        return both.sortWithinPartitions("centre", "salt", "kind", "home").mapInArrow(_searched(k), FOUND)

    # first pass: one shard of the query's own node
    first = asked.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    seeds = stored(
        search(first.selectExpr("*", "1 AS kind", "centre AS home", "CAST('-Infinity' AS DOUBLE) AS least")), "seeds"
    )
    kth = seeds.groupBy("query_row").agg(F.min("score").alias("kth"), F.count("*").alias("found"))
    kth = kth.select(F.col("query_row").alias("row"), F.when(F.col("found") >= k, F.col("kth")).alias("kth"))
    radius = np.array([known[c]["radius"] if c in known else -np.inf for c in range(len(net))])
    longest = np.array([known[c]["longest"] if c in known else 0.0 for c in range(len(net))])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes that may hold a row as good as the query's k-th."""
        for batch in batches:
            x, least = matrix(batch.column("vec")), batch.column("least").to_numpy()
            own = np.linalg.norm(x, axis=1)[:, None]
            most = np.minimum(product(x, net) + radius * own, longest * own)
            most += 1e-9 * (1 + own * (longest + np.linalg.norm(net, axis=1)))
            good = (most >= least[:, None]) & (radius >= 0)
            nodes = pa.array([np.flatnonzero(g).astype(np.int32) for g in good], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "nodes"])

    bounded = first.join(kth, "row", "left").selectExpr(
        "vec_id", "vec", "row", "centre AS home", "salt AS seen", "coalesce(kth, CAST('-Infinity' AS DOUBLE)) AS least"
    )
    kinds = "vec_id long, vec array<double>, row long, home int, seen int, least double"
    spread = bounded.mapInArrow(sent, f"{kinds}, nodes array<int>").withColumn("centre", F.explode("nodes"))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    rest = spread.where("centre <> home OR salt <> seen").withColumn("kind", F.lit(1))
    found = seeds.unionByName(search(rest))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
