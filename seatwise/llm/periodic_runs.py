"""Runs (maximal periodic stretches of words) of every text, by Baier's grouping.

Words are what the six ASCII white-space bytes separate. The first phase of Baier's suffix sorter
splits the suffixes into groups by their longest Lyndon prefix; the size of a suffix's last group is its
entry of the Lyndon array. It is taken under an order of the words and under its reverse: every run
has a Lyndon root that starts a longest Lyndon prefix under one of them. Two roots in a row, extended to
both sides through longest common extensions, give the runs.

Only runs of at least ``LEAST_LENGTH`` words and ``LEAST_EXPONENT`` periods count. Such a run holds each
of its words at least that many times, so before sorting, texts are cut at words that are rarer in
their part, until no cut is left. That loses no run.

A null or empty text has no words and no run. Equal rows and rows with equal or null ids are documents of
their own. A long text is handled whole, in memory that grows with its own length; short ones share
numpy calls, up to ``CHUNK_BYTES``. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import whole_text

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
CHUNK_BYTES = 1 << 22
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_array(words: np.ndarray, ends: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, under the order of ``words`` or its reverse.

    ``words`` holds several strings end to end; ``ends`` marks the last word of each. Groups are
    handled from the greatest down. When a group is handled, its suffixes leave the list of open places, so the
    place to their left is the nearest suffix of a lower group: its Lyndon prefix grows by that of
    the group, once for every suffix that points to it, and it moves to a group just above its own.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    # places 1..n with a bar before each string, which is never handled
    place = np.arange(n) + 1 + np.concatenate([[0], np.cumsum(ends[:-1])])
    total = int(place[-1]) + 2
    found = [0] * total
    order = np.argsort(-words if not reverse else words, kind="stable")
    sorted_words = words[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]))
    held = [part.tolist() for part in np.split(place[order], starts[1:])]
    group_at = np.full(total, -1)
    group_at[place[order]] = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [n]])))
    group = group_at.tolist()
    size = [1] * len(held)
    below = list(range(1, len(held))) + [-1]
    above = list(range(-1, len(held) - 1))
    left, right = list(range(-1, total - 1)), list(range(1, total + 1))
    now = 0
    while now >= 0:
        length, pointed = size[now], []
        last, times = -1, 0
        for at in held[now]:
            if group[at] != now:
                continue  # it has moved up since
            found[at] = length
            before, after = left[at], right[at]
            right[before] = after
            left[after if after < total else -1] = before
            if before == last:
                times += 1
            else:
                if last > 0 and group[last] >= 0:
                    pointed.append((times, last))
                last, times = before, 1
        if last > 0 and group[last] >= 0:
            pointed.append((times, last))
        held[now] = None
        moved: dict[tuple[int, int], int] = {}
        if len(pointed) > 1 and len({times for times, _ in pointed}) > 1:
            pointed.sort(key=lambda p: -p[0])  # stable: places stay ascending
        for times, at in pointed:
            old = group[at]
            new = moved.get((old, times))
            if new is None:
                new = moved[old, times] = len(size)
                size.append(size[old] + times * length)
                held.append([])
                over = above[old]
                above.append(over)
                below.append(old)
                above[old] = new
                if over >= 0:
                    below[over] = new
            group[at] = new
            held[new].append(at)
        now = below[now]
    return np.array(found)[place]


class Extensions:
    """Longest common extensions to the right and left, through names of all stretches of 2^k words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names, step = [words], 1
        while 2 * step <= longest:
            name = self.names[-1]
            top = np.int64(name.max()) + 1
            _, both = np.unique(name[:-step] * top + name[step:], return_inverse=True)
            self.names.append(both)
            step *= 2

    def right(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common words from ``one`` and ``other`` (the greater) on."""
        return self._walk(one, other, 1)

    def left(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common words before ``one`` and ``other``."""
        return self._walk(one, other, -1)

    def _walk(self, one: np.ndarray, other: np.ndarray, way: int) -> np.ndarray:
        common = np.zeros(len(one), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            a, b = one + way * common, other + way * common
            if way < 0:
                a, b = a - step, b - step
            inside = np.flatnonzero((a >= 0) & (b < len(name)))
            same = inside[name[a[inside]] == name[b[inside]]]
            common[same] += step
        return common


def dense_parts(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that a run can hold, and the part of the text each belongs to.

    Cuts at words that occur less than ``LEAST_EXPONENT`` times in their part, and drops parts that
    are shorter than ``LEAST_LENGTH``, until nothing changes.
    """
    kept = np.arange(len(words))
    top = np.int64(words.max(initial=0)) + 1
    while len(kept):
        _, which, times = np.unique(part * top + words[kept], return_inverse=True, return_counts=True)
        frequent = times[which] >= LEAST_EXPONENT
        cut = np.concatenate([[True], (part[1:] != part[:-1]) | ~frequent[1:] | ~frequent[:-1]])
        part = np.cumsum(cut)
        stays = frequent & (np.bincount(part)[part] >= LEAST_LENGTH)
        if stays.all():
            return kept, part
        kept, part = kept[stays], part[stays]
    return kept, part


def runs_of(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Runs as rows (start, length, period) in order, starts counted over all of ``words``.

    ``text`` numbers the texts that the words come from; no run leaves its text.
    """
    kept, part = dense_parts(words, text)
    if not len(kept):
        return np.zeros((0, 3), np.int64)
    own = words[kept]
    ends = np.append(part[1:] != part[:-1], True)
    # one bar, a word of its own, between parts, so that extensions end there
    place = np.arange(len(own)) + np.cumsum(np.concatenate([[0], ends[:-1]]))
    barred = np.arange(place[-1] + 2, dtype=np.int64) + own.max() + 1
    barred[place] = own
    roots = []
    for reverse in (False, True):
        root = np.zeros(len(barred), np.int64)
        root[place] = lyndon_array(own, ends, reverse)
        # a run of three periods or more begins with two equal roots in a row
        at = place[place + root[place] < len(barred)]
        period = root[at]
        twice = (root[at + period] == period) & (barred[at] == barred[at + period])
        roots.append(np.stack([at[twice], period[twice]]))
    at, period = np.concatenate(roots, axis=1)
    extended = Extensions(barred, int(np.bincount(part).max()))
    before = extended.left(at, at + period)
    length = before + period + extended.right(at, at + period)
    good = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    where = np.full(len(barred), -1)
    where[place] = kept
    runs = np.stack([where[(at - before)[good]], length[good], period[good]], axis=1)
    runs = np.unique(runs, axis=0)  # a run is found from each of its roots
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _texts(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs and the text without repetitions, for each text."""
    split = [t.encode().split() for t in texts]
    number = defaultdict(count().__next__)
    words = np.concatenate([np.array([*map(number.__getitem__, w)], np.int64) for w in split] or [np.zeros(0, np.int64)])
    sizes = np.array([len(w) for w in split], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    runs = runs_of(words, np.repeat(np.arange(len(split)), sizes))
    cuts = np.searchsorted(runs[:, 0], first)
    for k, own in enumerate(split):
        some = runs[cuts[k] : cuts[k + 1]] - [first[k], 0, 0]
        if len(some):
            stays = np.ones(len(own), bool)
            for start, length, period in some.tolist():
                stays[start + period : start + length] = False
            own = [own[i] for i in np.flatnonzero(stays).tolist()]
        yield int(sizes[k]), some.tolist(), b" ".join(own).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, its runs by start and period, and its text without what repeats.

    ``runs`` counts words from 0; of each run the first period stays in ``collapsed``, whose words are
    joined by one space.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            n_words, runs, collapsed = zip(*_texts(texts))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
            columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= CHUNK_BYTES:
                    yield one(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield one(ids, texts)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(find, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """The strongest run of each document and hashes of all runs and of the collapsed text."""
    # runs are in order of start and period, so the first of equal exponents stays
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),
        (best, r) -> CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    chosen = found.withColumn("best", best)
    return chosen.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where the end of every tenth text, by the hash of its id, repeats a few of its words.

    With h the crc32 of the id's digits (of the empty string for a null id) and g = h div 10: if h mod 10 is
    0, words from place a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words from there.
    """
    hashed = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    words = F.filter(F.split(whole_text(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # an array of one element, so that the words are split once and not at each use
    bound = F.array(F.struct(words.alias("words"), F.floor(hashed / 10).alias("g")))
    repeated = F.transform(bound, _with_repeated_end)[0]
    return docs.withColumn(text_col, F.when(hashed % 10 == 0, repeated).otherwise(whole_text(text_col)))


def _with_repeated_end(bound: Column) -> Column:
    words, n = bound["words"], F.size(bound["words"])
    a = (bound["g"] % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + bound["g"] % 8)).cast("int")
    end = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), end), " ")).otherwise("")
