"""Exact search with cover trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import cover_tree

KIND = "vec_id long, embedding array<double>, row string, centre string, label int"


def brute_force(rows, k, every=5):
    """Each query's best, by comparing with all rows; shorter vectors end in zeros."""
    usable = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for i, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i)
        found += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(found)


def clustered(rng, n, centres=6, dim=4):
    middle = rng.integers(-400, 400, (centres, dim))
    return (middle[rng.integers(0, centres, n)] + rng.integers(-9, 9, (n, dim))).astype(float)


@pytest.fixture
def small(monkeypatch):
    for name, size in (("SHARD", 40), ("LEAF", 4), ("CHILDREN", 5), ("QUERIES", 7)):
        monkeypatch.setattr(cover_tree, name, size)


def leaves(node):
    return [r for c in node.children for r in leaves(c)] if node.children else node.rows.tolist()


def check_cover(node, x):
    mine = leaves(node)
    assert (np.linalg.norm(x[mine] - node.centre, axis=1) <= node.radius + 1e-9).all()
    assert (np.linalg.norm(x[mine], axis=1) <= node.longest + 1e-9).all()
    for child in node.children:
        assert child.radius <= node.radius
        check_cover(child, x)


def test_trees_cover_their_rows(small):
    x = clustered(np.random.default_rng(1), 300)
    tree = cover_tree.cover_tree(x)
    assert sorted(leaves(tree)) == list(range(300)) and tree.children
    assert (tree.children[0].centre == tree.centre).all()
    check_cover(tree, x)


def test_pairs_of_nodes_are_left_out(small, monkeypatch):
    rng = np.random.default_rng(2)
    x, ids = clustered(rng, 600), np.arange(600)
    compared, plain = [], cover_tree.Search.compare
    monkeypatch.setattr(cover_tree.Search, "compare", lambda s, r, y, i: compared.append(len(r) * len(y)) or plain(s, r, y, i))
    queries = np.arange(0, 600, 10)
    search = cover_tree.Search(x[queries], ids[queries], np.full(60, -np.inf), 3)
    search.run(cover_tree.cover_tree(x), x, ids)
    assert sum(compared) < 60 * 600 / 3
    for at, own in enumerate(queries.tolist()):
        want = sorted((-s, j) for j, s in enumerate((x @ x[own]).tolist()) if j != own)[:3]
        assert list(zip((-search.score[at]).tolist(), search.id[at].tolist())) == want


def test_few_copies_keeps_what_any_query_needs():
    x = np.array([[1.0]] * 12 + [[2.0]])
    ids = np.array([3, 3, 3, 3, 5, 5, 6, 7, 8, 9, 1, 1, 4])
    kept = cover_tree.few_copies(x, ids, 2)
    assert ids[kept].tolist() == [3, 3, 5, 5, 1, 1, 4]


@pytest.mark.parametrize("k", [1, 5])
def test_search_on_odd_vectors(spark, small, k):
    rng = np.random.default_rng(3)
    vectors = [*clustered(rng, 220).tolist(), *[[7.0, -3.0, 1.0, 2.0]] * 130, *rng.integers(-2, 2, (60, 4)).astype(float).tolist()]
    rows = [(n, v) for n, v in enumerate(vectors)]
    rows += [(500, None), (505, [1.0, None]), (510, [float("nan")]), (515, [float("inf"), 1.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    rows += [(520, []), (525, [0.0] * 4), (530, [500.0, 1.0]), (5, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, 2.0, 3.0, 4.0]), (11, [9.0] * 6)]
    rows = [(*r, "r", "c", 1) for r in rows]
    frame = spark.createDataFrame(rows, KIND).repartition(4)
    found = cover_tree.top_matches(frame, F.col("vec_id") % 5 == 0, k)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, k)


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], KIND)
    assert cover_tree.top_matches(none, F.col("vec_id") % 5 == 0, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0], "r", "c", 1)], KIND)
    assert cover_tree.top_matches(one, F.col("vec_id") % 5 == 0, 5).count() == 0
    two = one.union(one.withColumn("vec_id", F.lit(3).cast("long")))
    assert [tuple(r) for r in cover_tree.top_matches(two, F.col("vec_id") % 5 == 0, 5).collect()] == [(0, 1, 3, 1.0)]
    assert cover_tree.top_matches(two.where("vec_id = 3"), F.col("vec_id") % 5 == 0, 5).count() == 0
