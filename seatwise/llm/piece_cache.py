"""Encoding of texts with a cache of the pieces between plain spaces.

A space between two characters that are not white space is always a border of the tokenizers' own
splitting, and a word tokenizer drops white space. So ids of a whole text are the joined ids of its
pieces, and each distinct piece goes through the tokenizer once while it stays in the cache. A text that may hold
the string of an added token, or this module's own mark, goes through the tokenizer as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from seatwise.llm.common import worker_cache

CACHED_CHARS = 48  # longer pieces are encoded again each time
CACHE_SIZE = 500_000  # pieces of each of two generations; the older is forgotten when the newer is full
PART_CHARS = 1 << 20  # longer texts are handled in parts
_MIXED = re.compile(r" \s|\s ")
_PLAIN = re.compile(r"(?<=\S) (?=\S)")
LATIN = frozenset(chr(c) for c in range(0x250) if chr(c).isalpha())
FIRST = "﷐"  # a noncharacter that marks a piece without a space before it


def _parts(text: str) -> Iterator[str]:
    """``text`` in parts, each but the first starting with a plain space."""
    start = 0
    while len(text) - start > PART_CHARS:
        border = _PLAIN.search(text, start + PART_CHARS)
        if not border:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


class PieceCache:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``encode(pieces)`` gives the ids of each piece as such bytes. With ``spaced`` a piece owns the
    space before it. A stop or comma after one of ``letters`` is always a piece of its own for the tokenizer.
    ``whole(text)`` gives the ids of a text that holds one of ``marks``.
    """

    def __init__(
        self, encode: Callable[[list[str]], list[bytes]], spaced: bool, letters: frozenset[str],
        whole: Callable[[str], bytes], marks: tuple[str, ...],
    ):
        self.encode, self.spaced, self.known = encode, spaced, {}
        self.letters, self.whole, self.marks = letters, whole, (FIRST, *marks)
        self.older: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        if not self.spaced:
            return text.split(" ")
        pieces = _PLAIN.split(text) if _MIXED.search(text) else text.split(" ")
        if pieces[0] or len(pieces) == 1:
            pieces[0] = FIRST + pieces[0]
        else:
            del pieces[0]  # the text starts with a plain space
        return pieces

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Puts ``pieces`` into the cache; returns those that are too long for it."""
        unknown = self._unknown(pieces)
        if len(self.known) + len(unknown) > CACHE_SIZE:
            self.older, self.known, unknown = self.known, {}, pieces
        new = self._recalled(unknown)
        ended = [p for p in new if p[-1:] in (".", ",") and p[-2:-1] in self.letters]
        whole = new.difference(ended)
        stems = self._recalled(self._unknown({p[:-1] for p in ended})) - whole
        if ended:
            whole |= self._recalled(self._unknown({FIRST + ".", FIRST + ","}))
        order = [*whole, *stems]
        raw = order
        if self.spaced:
            raw = [p[1:] if p[0:1] == FIRST else " " + p for p in order]
        elif ended:
            raw = [p.removeprefix(FIRST) for p in order]
        long, known = {}, self.known
        for piece, found in zip(order, self.encode(raw)):
            (known if len(piece) <= CACHED_CHARS else long)[piece] = found
        for piece in ended:
            stem = piece[:-1]
            found = (known[stem] if stem in known else long[stem]) + known[FIRST + piece[-1]]
            (known if len(piece) <= CACHED_CHARS else long)[piece] = found
        return long

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those of ``pieces`` that are not in the cache, which is asked for each; subtracting its keys goes through all of them."""
        known = self.known
        return {p for p in pieces if p not in known}

    def _recalled(self, pieces: set[str]) -> set[str]:
        """Those of ``pieces`` that the older generation does not have; the others are new again."""
        again = [p for p in pieces if p in self.older]
        for piece in again:
            self.known[piece] = self.older[piece]
        return pieces.difference(again)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        for start in range(0, len(texts), 512):
            some = texts[start : start + 512]
            apart = {k for k, t in enumerate(some) if any(m in t for m in self.marks)}
            if not apart:
                yield from self._some(some)
                continue
            found = self._some([t for k, t in enumerate(some) if k not in apart])
            for k, text in enumerate(some):
                yield self.whole(text) if k in apart else next(found)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        if any(len(t) > PART_CHARS for t in texts):
            for text in texts:
                yield b"".join(self._part(part) for part in _parts(text))
            return
        split = [self._pieces(t) for t in texts]
        extra = self._learn(set().union(*split))
        for pieces in split:
            yield self._join(pieces, extra)

    def _part(self, text: str) -> bytes:
        pieces = self._pieces(text)
        return self._join(pieces, self._learn(set(pieces)))

    def _join(self, pieces: list[str], extra: dict[str, bytes]) -> bytes:
        if not extra:
            return b"".join(map(self.known.__getitem__, pieces))
        known = self.known
        return b"".join([known[p] if p in known else extra[p] for p in pieces])


@worker_cache
def library_encoder(path: str, spaced: bool) -> PieceCache:
    """The tokenizers library with the file at ``path``, with its defaults but for ``add_special_tokens=False``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    border = tokenizer.encode(" |", add_special_tokens=False).ids
    if len(border) != 1:
        raise ValueError("' |' must be one token")

    def of(texts: list[str]) -> list[np.ndarray]:
        some = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in some]

    def encode(pieces: list[str]) -> list[bytes]:
        """Plain pieces share a call as one text with bars between; the others are encoded one by one."""
        found: list[bytes] = [b""] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if p and "|" not in p and " " not in p[1:] and p[0].isspace() == spaced]
        for start in range(0, len(plain), 256):
            some = plain[start : start + 256]
            (ids,) = of([" |".join([pieces[k] if spaced else " " + pieces[k] for k in some])])
            data, at = ids.tobytes(), (4 * np.flatnonzero(ids == border[0])).tolist()
            for k, first, end in zip(some, [-4, *at], [*at, len(data)]):
                found[k] = data[first + 4 : end]
        rest = sorted(set(range(len(pieces))).difference(plain))
        for k, own in zip(rest, of([pieces[k] for k in rest])):
            found[k] = own.tobytes()
        return found

    def normal(text: str) -> str:
        return tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text

    # letters that stay letters, unlike a capital I with a dot, whose dot becomes a mark that joins the stop
    letters = frozenset(c for c in LATIN if all(unicodedata.category(n)[0] == "L" for n in normal(c)))
    # the start of an added token's string up to its first letter, which case or normal form can't change;
    # with an empty start every text is encoded as a whole
    starts = {re.match(r"[!-/:-@\[-`{-~]*", t.content)[0] for t in tokenizer.get_added_tokens_decoder().values()}
    return PieceCache(encode, spaced, letters, lambda text: of([text])[0].tobytes(), tuple(sorted(starts)))
