"""Runs of words against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from seatwise.llm import periodic_runs as runs


def lyndon_prefixes(words):
    """Length of the longest Lyndon word at each place, by comparing all of its suffixes."""
    n = len(words)
    is_lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
    return [max(j - i for j in range(i + 1, n + 1) if is_lyndon(words[i:j])) for i in range(n)]


def plain_runs(words):
    found, n = [], len(words)
    for period in range(1, n // 4 + 1):
        start = 0
        while start + period < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if length >= max(6, 4 * period):
                inside = words[start : start + length]
                if not any(inside[d:] == inside[:-d] for d in range(1, period)):
                    found.append((start, length, period))
            start = max(end, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digests(doc, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for start, length, period in found for i in range(start + period, start + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    strongest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(found), *strongest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_words(rng, most):
    words = []
    while len(words) < rng.randint(0, most):
        if rng.random() < 0.6:
            words += [rng.randint(0, 3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8)
        else:
            words += [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]
    return words


@pytest.mark.parametrize("reverse", [False, True])
def test_lyndon_arrays_of_strings_end_to_end(reverse):
    rng = random.Random(1)
    for _ in range(150):
        strings = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        ends = np.concatenate([[False] * (len(s) - 1) + [True] for s in strings])
        want = [n for s in strings for n in lyndon_prefixes([-w if reverse else w for w in s])]
        assert runs.lyndon_array(np.array(sum(strings, [])), ends, reverse).tolist() == want


def test_extensions():
    rng = random.Random(2)
    words = np.array([rng.randint(0, 1) for _ in range(200)])
    extended = runs.Extensions(words, 200)
    pairs = [sorted(rng.sample(range(200), 2)) for _ in range(300)]
    one, other = np.array(pairs).T
    right, left = extended.right(one, other), extended.left(one, other)
    for (i, j), r, l in zip(pairs, right.tolist(), left.tolist()):
        assert (words[i : i + r] == words[j : j + r]).all() and (j + r == 200 or words[i + r] != words[j + r])
        assert (words[i - l : i] == words[j - l : j]).all() and (i == l or words[i - l - 1] != words[j - l - 1])


def test_runs_against_the_definition():
    rng = random.Random(3)
    for _ in range(600):
        texts = [periodic_words(rng, 70) for _ in range(rng.randint(1, 4))]
        found = runs._texts([" ".join(map(str, t)) for t in texts])
        assert [[tuple(r) for r in own] for _, own, _ in found] == [plain_runs(t) for t in texts]


def test_runs_that_start_together():
    words = list("aaaaaab" * 4)
    assert [tuple(r) for r in next(runs._texts([" ".join(words)]))[1]] == plain_runs(words)
    assert (0, 6, 1) in plain_runs(words) and (0, 28, 7) in plain_runs(words)


@pytest.fixture(scope="module")
def periodic_docs(spark, odd_texts):
    rng = random.Random(4)
    texts = [*odd_texts, "a b " * 1000, " \t x\n\x0bx\x0cx\rx x x x", "x x " * 7]
    texts += [" ".join(map(str, periodic_words(rng, 90))) for _ in range(150)]
    rows = [(k, t, "s", "h", 1, "c") for k, t in enumerate(texts)]
    # the crc32 of the digits of 37 and 40 is a multiple of ten
    more = [(None, "a b c d e f"), (None, None), (7, "q " * 9), (7, "q " * 9), (37, None), (40, " ")]
    rows += [(*row, "s", "h", 1, "c") for row in more]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, g string, n_words long, collapsed string")


@pytest.mark.parametrize("chunk", [runs.CHUNK_BYTES, 50])
def test_query_on_odd_documents(spark, periodic_docs, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK_BYTES", chunk)
    docs = periodic_docs.repartition(3)
    found = runs.digests(runs.periodic_runs(runs.with_planted_runs(docs)))
    want = [plain_digests(r["doc_id"], r["text"]) for r in periodic_docs.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert runs.digests(runs.periodic_runs(runs.with_planted_runs(no_docs))).count() == 0
    assert any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 and not r["text"] for r in periodic_docs.collect())


def test_registered_query(spark, sf_dir):
    from seatwise.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, sf_dir).collect()))
    assert found == sorted(plain_digests(r["doc_id"], r["text"]) for r in docs)
