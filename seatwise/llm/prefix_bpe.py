"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every byte prefix has one last token. If that token is known for all shorter prefixes,
the last token of a prefix is the one among its suffixes that fits: what stands before it must end in a
token with which it forms a pair that encodes to itself. So a table with one token per prefix encodes
the whole, grows byte by byte (an append touches only new prefixes), and after an edit needs only the
prefixes from the edit to where a token border and all that follows agree with the old table.
The encoding of a text is read from the table's end backwards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import whole_text
from seatwise.llm.piece_cache import LATIN, PieceCache

PAIRS_KEPT = 1_000_000
ENCODED = "doc_id long, ids binary, decoded binary"


class Ranks:
    """A vocabulary of byte strings by rank, and which pairs of its tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost; for pairs of tokens only."""
        get, none = self.ranks.get, 1 << 60
        parts = [data[k : k + 1] for k in range(len(data))]
        ranked = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranked:
            best = min(ranked)
            if best == none:
                break
            k = ranked.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            # only the pairs on both sides of the merged one are others now
            del ranked[k]
            if k:
                ranked[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranked):
                ranked[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` after ``before`` (-1: nothing) is encoded as just these tokens."""
        known = self.fits.get((before, token))
        if known is None:
            first = [self.bytes[before]] if before >= 0 else []
            second = self.bytes[token]
            known = self.merged(b"".join(first) + second) == [*first, second]
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            self.fits[before, token] = known
        return known


@lru_cache
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


class PrefixTable:
    """The last token of every prefix of ``data``; ``tokens`` reads the encoding from it."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def _fill(self, upto: int) -> None:
        """The last tokens of the prefixes that have none yet, to that of ``upto`` bytes."""
        data, last, ranks = self.data, self.last, self.ranks
        token_of, known, longest = ranks.ranks.get, ranks.fits.get, ranks.longest
        for end in range(len(last) + 1, upto + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(data[start:end])
                if token is None:
                    continue
                before = last[start - 1] if start else -1
                fits = known((before, token))
                if ranks.may_follow(before, token) if fits is None else fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes ``start:end``; returns how many prefixes were computed anew.

        What follows the edit is taken over once as many prefixes in a row as the longest token has
        bytes have the token that they had before: later ones see nothing else.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        alike = 0
        for at in range(start + 1, len(self.data) + 1):
            if alike >= self.ranks.longest:
                self.last += old[at - 1 - shift :]
                return at - 1 - start
            self._fill(at)
            before = at - 1 - shift
            alike = alike + 1 if at > start + len(new) and old[before] == self.last[-1] else 0
        return len(self.data) - start

    def tokens(self) -> list[int]:
        end, found = len(self.data), []
        while end:
            found.append(self.last[end - 1])
            end -= len(self.ranks.bytes[found[-1]])
        return found[::-1]


def encode_match(ranks: Ranks, match: bytes) -> list[int]:
    """The ids of one match of the splitting pattern; a match that is a token itself is that token."""
    whole = ranks.ranks.get(match)
    return [whole] if whole is not None else PrefixTable(ranks, match).tokens()


@lru_cache
def prefix_encoder(path: str, pattern: str) -> PieceCache:
    ranks, splitter = load_ranks(path), regex.compile(pattern)

    def encode(pieces: list[str]) -> list[bytes]:
        return [
            np.array(
                [i for m in splitter.findall(piece) for i in encode_match(ranks, m.encode())], "<u4"
            ).tobytes()
            for piece in pieces
        ]

    return PieceCache(encode, True, LATIN, lambda text: encode([text])[0], ())


def decode(ranks: Ranks, ids: bytes) -> bytes:
    return b"".join(map(ranks.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: doc_id, ids (little-endian unsigned 32-bit), decoded bytes.

    A null text is empty and has no ids; ids of documents may be null or repeated. Each partition is
    one stream, a batch of texts at a time; only the cache of pieces, of bounded size, is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = prefix_encoder(path, pattern), load_ranks(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                ids = list(encoder.texts(some.column(1).to_pylist()))
                columns = [
                    some.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array([decode(ranks, i) for i in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
