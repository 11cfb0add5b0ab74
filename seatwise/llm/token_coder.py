"""Token ids in range-coded files: context mixing over blocks that are coded side by side.

A block holds up to 2048 consecutive ids and starts with empty models. For the next id each order makes
a prediction: order 2 the id that last followed the two ids before it, order 1 the id that last followed
the one before it, order 0 the frequencies of the ids of the block so far (summed anew every 128 ids).
A mixer of adaptive counts, chosen by how often the two predictions have just held and whether they
agree, weighs the three against an id that is new; the mixed distribution drives a range coder with
16-bit output. numpy codes thousands of blocks at once, one id of each block in a step; coder and
decoder share the model. Each block has a CRC-32 of its ids and can be decoded alone.

A file is a row of frames of whole documents. A frame, all little-endian:
magic ``TIDF``, block size u4, vocabulary size u4, documents u8, ids u8, blocks u8, CRC-32 u4 of the
three tables that follow: document ids i8 (null: the least value), ids per document u8, per block
(16-bit words u4, CRC-32 u4); then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 2048
LANES = 4096
SUMMED_EVERY = 128
SLOTS = 2048  # of the order-1 and order-2 tables of a block
LEVELS = 4  # of confidence: no prediction, new, held once, held more often
STEP = 4  # added to a mixer count
HEAD = struct.Struct("<4sIIQQQI")
NO_ID = -(2**63)
BIT16 = 1 << 16


class _Models:
    """The models of ``n`` blocks side by side, after the ids that were added."""

    def __init__(self, n: int, size: int, vocabulary: int):
        self.n, self.size, self.vocabulary = n, size, vocabulary
        self.lane = np.arange(n)
        self.ids = np.zeros((size, n), np.uint16)
        self.entries = np.zeros((size, n), np.uint16)
        self.last = [np.zeros(n * SLOTS, np.uint16) for _ in range(2)]  # position + 1
        self.held = [np.zeros(n * SLOTS, np.uint8) for _ in range(2)]
        self.mixer = np.ones((n * 2 * LEVELS * LEVELS, 4), np.int64)
        self.counts = np.zeros((n, size), np.uint16)
        self.entry_ids = np.zeros(n * size, np.uint16)
        self.new = np.zeros(n, np.int64)  # entries of each block
        self.at = 0
        self.sums, self.width, self.total, self.summed = None, 0, np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self) -> None:
        i, ids, lane = self.at, self.ids, self.lane
        if i % SUMMED_EVERY == 0 and i:
            self.width = int(self.new.max())
            sums = np.zeros((self.n, self.width + 1), np.int64)
            np.cumsum(self.counts[:, : self.width], axis=1, out=sums[:, 1:])
            self.total = sums[:, -1].copy()
            self.summed = self.new.copy()
            sums += (lane * BIT16)[:, None]
            self.sums = sums.ravel()
        one = ids[i - 1].astype(np.int64) if i else np.zeros(self.n, np.int64)
        two = ids[i - 2].astype(np.int64) if i > 1 else np.zeros(self.n, np.int64)
        base = lane * SLOTS
        self.slot = [
            base + ((one * 40503 >> 4) & (SLOTS - 1)),
            base + (((one * 40503 + two * 30011) >> 4) & (SLOTS - 1)),
        ]
        place = [t[s].astype(np.int64) for t, s in zip(self.last, self.slot)]
        self.sure = [t[s] for t, s in zip(self.held, self.slot)]
        self.empty = [p == 0 for p in place]
        flat = self.ids.ravel()
        self.from_ = [np.maximum(p - 1, 0) * self.n + lane for p in place]
        self.guess = [flat[f] for f in self.from_]
        agree = self.guess[0] == self.guess[1]
        self.mix = (
            (lane * LEVELS + self.sure[1]) * LEVELS + self.sure[0]
        ) * 2 + agree
        self.weights = self.mixer[self.mix]

    def add(self, ids: np.ndarray, entries: np.ndarray, choice: np.ndarray) -> None:
        i, lane = self.at, self.lane
        self.ids[i] = ids
        self.entries[i] = entries
        self.weights[lane, choice] += STEP
        self.mixer[self.mix] = self.weights
        for k in (0, 1):
            right = (self.guess[k] == ids) & ~self.empty[k]
            self.held[k][self.slot[k]] = np.where(right, np.minimum(self.sure[k] + 1, LEVELS - 1), 1)
            self.last[k][self.slot[k]] = i + 1
        at = lane * self.size + entries
        self.counts.ravel()[at] += 1
        fresh = np.flatnonzero(choice == 3)
        self.entry_ids[at[fresh]] = ids[fresh]
        self.new[fresh] += 1
        self.at += 1


class _Coder:
    def __init__(self, n: int, size: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, 1 << 32, np.int64)
        self.out = np.zeros((2 * size + 3, n), np.int32)
        self.words = np.zeros(n, np.int64)

    def put(self, at: np.ndarray | slice, start, width, total) -> None:
        low, span = self.low[at], self.range[at]
        each = (span / total).astype(np.int64)  # exact: below 2**53, and no rounding reaches a whole number
        low, span = low + each * start, each * width
        small = np.flatnonzero(span < BIT16)
        lanes = small if isinstance(at, slice) else at[small]
        self.out[self.words[lanes], lanes] = low[small] >> 16
        self.words[lanes] += 1
        low[small] = (low[small] & 0xFFFF) << 16
        span[small] <<= 16
        self.low[at], self.range[at] = low, span

    def finish(self) -> list[np.ndarray]:
        lanes = np.arange(len(self.low))
        self.out[self.words, lanes] = self.low >> 16
        self.out[self.words + 1, lanes] = self.low & 0xFFFF
        self.words += 2
        for row in range(int(self.words.max()) - 1, 0, -1):
            self.out[row - 1] += self.out[row] >> 16
            self.out[row] &= 0xFFFF
        columns = np.ascontiguousarray(self.out.T.astype("<u2"))
        return [columns[k, :w] for k, w in enumerate(self.words)]


def _earlier(ids: np.ndarray) -> np.ndarray:
    """For each id of each block (columns) the position of the one before it that is equal, or -1."""
    size, n = ids.shape
    key = (ids.astype(np.int64) + (np.arange(n) << 16)).ravel()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.full(size * n, -1, np.int64)
    found[order[1:][same]] = order[:-1][same] // n
    return found.reshape(size, n)


def code_blocks(ids: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    """The 16-bit words of each block; ``ids`` has a column for each, all of one length."""
    size, n = ids.shape
    models, coder, earlier, lane = _Models(n, size, vocabulary), _Coder(n, size), _earlier(ids), np.arange(n)
    flat_entries = models.entries.ravel()
    everyone = slice(None)
    for i in range(size):
        models.predict()
        x, before = ids[i], earlier[i]
        entry = flat_entries[np.maximum(before, 0) * n + lane].astype(np.int64)
        known = (before >= 0) & (entry < models.summed)
        choice = np.where(known, 2, 3)
        for k in (0, 1):
            by = np.flatnonzero((models.guess[k] == x) & ~models.empty[k])
            choice[by] = 1 - k
            entry[by] = flat_entries[models.from_[k][by]]
        weights = models.weights
        sums = np.cumsum(weights, axis=1)
        width = weights[lane, choice]
        coder.put(everyone, sums[lane, choice] - width, width, sums[:, 3])
        by = np.flatnonzero(choice == 2)
        if len(by):
            at = by * (models.width + 1) + entry[by]
            start = models.sums[at] - by * BIT16
            coder.put(by, start, models.sums[at + 1] - by * BIT16 - start, models.total[by])
        by = np.flatnonzero(choice == 3)
        if len(by):
            coder.put(by, x[by].astype(np.int64), 1, vocabulary)
            entry[by] = models.new[by]
        models.add(x, entry, choice)
    return coder.finish()


def decode_blocks(words: np.ndarray, size: int, vocabulary: int) -> np.ndarray:
    """The ids of blocks of ``size`` ids, a column each; ``words`` has their words as columns, then zeros."""
    n = words.shape[1]
    models, lane = _Models(n, size, vocabulary), np.arange(n)
    flat_entries, flat_ids = models.entries.ravel(), models.ids
    flat_words = words.ravel()
    code = words[0].astype(np.int64) << 16 | words[1]
    span, read = np.full(n, 1 << 32, np.int64), np.full(n, 2, np.int64)

    def take(at, start, width, each) -> None:
        left, size_ = code[at] - each * start, each * width
        small = np.flatnonzero(size_ < BIT16)
        lanes = small if isinstance(at, slice) else at[small]
        left[small] = left[small] << 16 | flat_words[read[lanes] * n + lanes]
        size_[small] <<= 16
        read[lanes] += 1
        code[at], span[at] = left, size_

    for _ in range(size):
        models.predict()
        sums = np.cumsum(models.weights, axis=1)
        each = (span / sums[:, 3]).astype(np.int64)
        aim = (code / each).astype(np.int64)
        choice = (aim >= sums[:, 0]).astype(np.int64) + (aim >= sums[:, 1]) + (aim >= sums[:, 2])
        width = models.weights[lane, choice]
        take(slice(None), sums[lane, choice] - width, width, each)
        copied = np.where(choice == 0, models.from_[1], models.from_[0])
        x = np.where(choice == 0, models.guess[1], models.guess[0])
        entry = flat_entries[copied].astype(np.int64)
        by = np.flatnonzero(choice == 2)
        if len(by):
            each = (span[by] / models.total[by]).astype(np.int64)
            aim = np.minimum((code[by] / each).astype(np.int64), models.total[by] - 1)
            at = np.searchsorted(models.sums, aim + by * BIT16, side="right") - 1
            start = models.sums[at] - by * BIT16
            take(by, start, models.sums[at + 1] - by * BIT16 - start, each)
            entry[by] = at - by * (models.width + 1)
            x[by] = models.entry_ids[by * size + entry[by]]
        by = np.flatnonzero(choice == 3)
        if len(by):
            each = (span[by] / vocabulary).astype(np.int64)
            aim = np.minimum((code[by] / each).astype(np.int64), vocabulary - 1)
            take(by, aim, 1, each)
            entry[by], x[by] = models.new[by], aim
        models.add(x, entry, choice)
    return flat_ids


def _groups(n_ids: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(first block, blocks, ids of each block): full blocks in groups of lanes, then the rest."""
    full = n_ids // block
    for first in range(0, full, LANES):
        yield first, min(LANES, full - first), block
    if n_ids % block:
        yield full, 1, n_ids % block


def frame(doc_ids: list[int | None], ids_of: list[bytes], vocabulary: int) -> bytes:
    """A frame of whole documents from their ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(ids_of), "<u4")
    if vocabulary > BIT16 or (len(ids) and int(ids.max()) >= vocabulary):
        raise ValueError("ids must be below the vocabulary size, and that at most 65536")
    block = BLOCK
    while block > 256 and len(ids) < 512 * block:  # few ids: shorter blocks, so that enough run side by side
        block //= 2
    words, sums = [], []
    for first, n, size in _groups(len(ids), block):
        start = first * block
        part = ids[start : start + n * size].reshape(n, size)
        words += code_blocks(np.ascontiguousarray(part.T.astype(np.uint16)), vocabulary)
        sums += [zlib.crc32(b) for b in part]
    tables = (
        np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([len(b) // 4 for b in ids_of], "<u8").tobytes()
        + np.array([(len(w), zlib.crc32(w.tobytes()), c) for w, c in zip(words, sums)], "<u4").tobytes()
    )
    fields = (b"TIDF", block, vocabulary, len(doc_ids), len(ids), len(words))
    head = HEAD.pack(*fields, zlib.crc32(tables, zlib.crc32(HEAD.pack(*fields, 0))))
    return b"".join([head, tables, *[w.tobytes() for w in words]])


def read_frame(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """(document ids, ids per document, all ids) of a frame; ValueError if a checksum does not hold.

    Words are checked before they are decoded, ids after.
    """
    if len(data) < HEAD.size:
        raise ValueError("not a frame")
    *fields, crc = HEAD.unpack_from(data)
    magic, block, vocabulary, n_docs, n_ids, n_blocks = fields
    tables = data[HEAD.size : HEAD.size + 16 * n_docs + 12 * n_blocks]
    if magic != b"TIDF" or zlib.crc32(tables, zlib.crc32(HEAD.pack(*fields, 0))) != crc:
        raise ValueError("not a frame, or its tables are damaged")
    doc_ids = np.frombuffer(tables, "<i8", n_docs)
    lengths = np.frombuffer(tables, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    table = np.frombuffer(tables, "<u4", 3 * n_blocks, 16 * n_docs).reshape(-1, 3)
    starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
    if len(data) != HEAD.size + len(tables) + 2 * starts[-1]:
        raise ValueError("a frame is cut off or too long")
    payload = np.frombuffer(data, "<u2", -1, HEAD.size + len(tables))
    for k in range(n_blocks):
        if zlib.crc32(payload[starts[k] : starts[k + 1]].tobytes()) != table[k, 1]:
            raise ValueError("a block is damaged")
    ids = np.zeros(n_ids, "<u4")
    for first, n, size in _groups(n_ids, block):
        own = table[first : first + n, 0].astype(np.int64)
        words = np.zeros((n, int(own.max()) + 2), np.uint16)
        words[np.arange(words.shape[1]) < own[:, None]] = payload[starts[first] : starts[first + n]]
        part = decode_blocks(np.ascontiguousarray(words.T), size, vocabulary).T.astype("<u4")
        if [zlib.crc32(np.ascontiguousarray(b)) for b in part] != table[first : first + n, 2].tolist():
            raise ValueError("a block is damaged")
        ids[first * block : first * block + n * size] = part.ravel()
    return [None if d == NO_ID else int(d) for d in doc_ids], lengths.tolist(), ids
