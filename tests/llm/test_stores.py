"""Archives and the permutation index against plain versions."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import permutation_index, warc
from seatwise.llm.common import new_folder, open_store

PAGES = "page_id long, url string, html string, size string"


@pytest.fixture(scope="module")
def archive(spark):
    rows = [
        (1, "http://a/1", "<p>x</p>", ""), (2, "http://a/2", "<p>x</p>", ""), (3, None, "é" * 50_000, ""),
        (4, "http://b\r\n/4", None, ""), (5, "http://b/5", "", ""), (None, "http://c", "<p>x</p>", ""),
        (6, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\nb", ""), (6, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\nb", ""),
    ]
    folder = new_folder(spark, "test-warc")
    files = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), folder)
    assert files.agg(F.sum("n_records")).first()[0] == len(rows)
    return folder


def test_archived_pages(spark, archive):
    found = sorted(map(tuple, warc.archived_pages(spark, archive).collect()), key=str)
    digest = lambda text: warc.sha1_base32(text.encode())
    x, odd = digest("<p>x</p>"), "a\r\n\r\nWARC/1.1\r\n\r\nb"
    assert found == sorted(
        [
            (1, 8, x, "revisit", 2), (2, 8, x, "response", None), (None, 8, x, "revisit", 2),
            (3, 100_000, digest("é" * 50_000), "response", None), (4, 0, digest(""), "revisit", 5),
            (5, 0, digest(""), "response", None), (6, len(odd), digest(odd), "response", None),
            (6, len(odd), digest(odd), "response", None),
        ],
        key=str,
    )


def test_predicates_and_columns(spark, archive):
    warc.register(spark)
    read = spark.read.format("warc").load(archive)
    assert read.where("record_type = 'revisit' and target_uri = 'http://a/1'").count() == 1
    assert read.where("target_uri like 'http://a%'").select("record_id").count() == 2
    assert read.where("record_type = 'response'").agg(F.sum("payload_bytes")).first()[0] == 8 + 100_000 + 2 * 18
    assert read.where("record_type in ('warcinfo', 'none')").select("payload").count() >= 1
    assert read.where("payload_bytes = 100000").count() == 1


def test_payloads_that_are_dropped_are_not_decoded(archive):
    store, root = open_store(archive)
    from pyarrow import fs

    path = max(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.size).path
    data = store.open_input_file(path).read()
    plain = gzip.decompress(data)

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    for form in (data, plain, b"".join(gzip.compress(m) for m in members(plain))):
        got = list(warc.records(File(form), lambda h: True, True))
        none = list(warc.records(File(form), lambda h: h["WARC-Type"] == "response", False))
        assert len(got) >= 2 and all(p is None for _, _, p in none)
        assert [h["WARC-Record-ID"] for h, _, _ in none] == [h["WARC-Record-ID"] for h, _, _ in got if h["WARC-Type"] == "response"]


def members(plain):
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    at = 0
    while at < len(plain):
        head = plain[at:].partition(b"\r\n\r\n")[0]
        n = len(head) + 4 + int(warc._headers(head)["Content-Length"]) + 4
        yield plain[at : at + n]
        at += n


def test_damaged_payloads_are_found(archive):
    data = warc.member(warc._page_record({"response": True, "sha1": "00" * 20, "size": 1, "html": "x", "page_id": 1, "url": "u", "keep_id": 1}, "d"))

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    with pytest.raises(ValueError):
        list(warc.records(File(data), lambda h: True, True))


def test_small_payloads_and_no_pages(spark):
    rows = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], PAGES)
    folder = new_folder(spark, "test-warc")
    warc.write_archives(rows, folder, least_bytes=3)
    assert {r["record_type"] for r in warc.archived_pages(spark, folder).collect()} == {"response"}
    folder = new_folder(spark, "test-warc")
    warc.write_archives(rows.limit(0), folder)
    open_store(folder)[0].create_dir(open_store(folder)[1])
    assert warc.archived_pages(spark, folder).count() == 0


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=8).tolist(), 0) for k in range(15)]
    vectors += [(20, vectors[3][1], 0), (40, vectors[3][1], 0), (50, None, 0), (60, [0.0] * 8, 0), (80, [1.0] * 3, 0)]
    vectors += [(100, [float("nan")] + [1.0] * 7, 0), (120, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int")
    found = permutation_index.nearest(table, F.col("vec_id") % 20 == 0).collect()
    good = {k: np.array(v) for k, v, _ in vectors[:17]}
    for query in (0, 20, 40):
        want = sorted(((-(good[query] * v).sum(), k) for k, v in good.items() if k != query))[:20]
        rows = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [v for _, v in rows] == [k for _, k in want] and [r for r, _ in rows] == list(range(1, 17))
    assert {r["query_id"] for r in found} == {0, 20, 40}
    assert permutation_index.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [0, 1])
def test_recall(spark, monkeypatch, scale):
    """Random vectors, which have no neighbourhoods to help, of equal and of unequal length."""
    monkeypatch.setattr(permutation_index, "BLOCK", 1500)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(scale * 0.5 * rng.normal(size=(6000, 1)))
    x[3000:3400] = x[3000]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = permutation_index.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    recall = []
    for query, rows in found.groupby("query_id"):
        score = x @ x[query]
        score[query] = -np.inf
        recall.append((score[rows["vec_id"]] >= np.sort(score)[-20] - 1e-12).mean())
        assert len(rows) == 20 and np.allclose(rows["score"], score[rows["vec_id"]], atol=1e-12)
    assert len(recall) == 300 and np.mean(recall) >= 0.9
