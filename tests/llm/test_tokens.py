"""Token files, packing and prefix BPE against the libraries."""

import base64
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from seatwise.llm import language_cnn, piece_cache, prefix_bpe
from seatwise.llm.packing import CHUNK, pack, pack_documents, tokenized
from seatwise.llm.token_coder import frame, read_frame
from seatwise.llm.token_files import token_file_round_trip

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library_ids(path, texts, end=None):
    tokenizer = Tokenizer.from_file(path)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids + ([] if end is None else [end]), "<u4") for e in found]


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
@pytest.mark.parametrize("size, part", [(piece_cache.CACHE_SIZE, piece_cache.PART_CHARS), (40, 60)])
def test_cached_pieces_are_whole_texts(monkeypatch, odd_texts, path, spaced, size, part):
    monkeypatch.setattr(piece_cache, "CACHE_SIZE", size)
    monkeypatch.setattr(piece_cache, "PART_CHARS", part)
    rng = random.Random(1)
    bits = ["a", "b ", " ", "  ", "\n", "'", "s", ".", ",", "|", "é", "1", "!", "\t", "　", "漢", "́", "ing"]
    bits += ["İ", "TARİHİ", "ß", "Å", "K", "ǆ", "ŉ", "ª", "<|endoftext|>", "<|", "<|STARTOFTEXT|>", piece_cache.FIRST]
    texts = [t or "" for t in odd_texts]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(bits[:-5]) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    texts += [piece_cache.FIRST + " x " + piece_cache.FIRST, "\x1c a", " ́a", "TARİHİ, yeni", "\ufdd0abc end.", "a <|endoftext|> b."]
    texts += ["".join(chr(rng.randint(32, 0x250)) for _ in range(3)) + rng.choice(".,") for _ in range(5000)]
    cache = piece_cache.library_encoder.__wrapped__(path, spaced)
    assert list(cache.texts(texts)) == [i.tobytes() for i in library_ids(path, texts)]


def test_frames_round_trip_and_checksums():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 5), (700, 3), (5000, 50_257), (40_000, 60)):
        ids = rng.integers(0, top, n).astype("<u4")
        data = frame([None, 7], [ids[: n // 3].tobytes(), ids[n // 3 :].tobytes()], 50_257)
        docs, lengths, found = read_frame(data)
        assert docs == [None, 7] and lengths == [n // 3, n - n // 3] and (found == ids).all()
    for _ in range(200):
        damaged = bytearray(data)
        damaged[rng.integers(0, len(data))] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError):
            read_frame(bytes(damaged))
    for cut in (0, 5, 40, len(data) - 1, len(data) - 2):
        with pytest.raises(ValueError):
            read_frame(data[:cut])
    with pytest.raises(ValueError):
        frame([1], [np.array([70_000], "<u4").tobytes()], 50_257)


def test_repeating_ids_are_coded_short():
    ids = np.tile(np.arange(50, dtype="<u4"), 2000)
    assert len(frame([1], [ids.tobytes()], 50_257)) < len(ids)


def test_token_files(odd_docs, no_docs, odd_texts):
    found = sorted(map(tuple, token_file_round_trip(odd_docs, BYTES).collect()))
    want, start = [], 0
    for k, ids in enumerate(library_ids(BYTES, odd_texts, 0)):
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == want
    assert token_file_round_trip(no_docs, BYTES).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (-1, None)], "doc_id long, text string")
    found = sorted(token_file_round_trip(docs, BYTES).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, -1, 3, 3]
    assert [r["start"] for r in found] == [0, 2, 3, 5]


def check_pieces(rows, ids_of, length):
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = ids_of[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids)
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))

    def covered(parts):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        return at

    assert {d: covered(p) for d, p in by_doc.items()} == {d: len(i) for d, i in ids_of.items()}
    full = [covered(by_sequence[s]) for s in sorted(by_sequence)]
    assert all(n == length for n in full[:-1]) and sorted(by_sequence) == list(range(len(full)))


@pytest.mark.parametrize("length", [4096, 64])
def test_packing(odd_docs, no_docs, odd_texts, length):
    ids_of = dict(enumerate(library_ids(WORDS, odd_texts, 2)))
    check_pieces(pack_documents(odd_docs, WORDS, 2, length=length).collect(), ids_of, length)
    assert pack_documents(no_docs, WORDS, 2).count() == 0


def test_a_long_document_is_stored_in_chunks(spark):
    text = "word " * (CHUNK + 10)
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    rows = tokenized(docs, WORDS, 2, False)
    assert rows.where("doc_id = 1").count() == 2
    ids_of = dict(zip((1, 2), library_ids(WORDS, [text, "x"], 2)))
    check_pieces(pack(rows).collect(), ids_of, 4096)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_bpe(odd_docs, no_docs, odd_texts, reference):
    found = prefix_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(odd_texts)
    for r in found:
        text = odd_texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert r["decoded"] == text.encode()
    assert prefix_bpe.digests(prefix_bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_appends_and_edits_give_the_table_of_the_whole():
    ranks, rng = prefix_bpe.load_ranks(RANKS), random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeist hn") for _ in range(150))
        table = prefix_bpe.PrefixTable(ranks, data[:70])
        table.append(data[70:])
        start = rng.randint(0, 150)
        end, new = rng.randint(start, min(150, start + 9)), bytes(rng.choice(b"ting") for _ in range(rng.randint(0, 6)))
        computed = table.edit(start, end, new)
        whole = prefix_bpe.PrefixTable(ranks, data[:start] + new + data[end:])
        assert table.last == whole.last and table.tokens() == whole.tokens()
        assert computed <= len(new) + 2 * ranks.longest + 40


def test_merging_looks_up_each_pair_once():
    """Only the two pairs beside a merged one are looked up again."""

    class Counted(dict):
        looked_up = 0

        def get(self, *args):
            self.looked_up += 1
            return super().get(*args)

    ranks = Counted({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"cab": 259})
    data = b"abcab" * 40
    assert prefix_bpe.Ranks(ranks).merged(data) == [b"ab"] + [b"c", b"abab"] * 39 + [b"cab"]
    assert ranks.looked_up < 3 * len(data)


def test_a_batch_does_not_go_through_the_whole_cache():
    """The cache is asked for a batch's pieces; what it holds besides does not count."""

    class Cache(dict):
        def __iter__(self):
            raise AssertionError("all cached pieces are gone through")

        def keys(self):
            raise AssertionError("all cached pieces are gone through")

    cache = piece_cache.PieceCache(lambda pieces: [p.encode() for p in pieces], True, piece_cache.LATIN, str.encode, ())
    cache.known, cache.older = Cache(), Cache({"old": b" old", "end": b" end"})
    assert list(cache.texts(["new old", "old end. new"])) == [b"new old", b"old end. new"]
    assert list(cache.texts(["new old"])) == [b"new old"]


def test_language_lets_go_the_pieces_that_a_worker_kept():
    """A worker that packed texts before does not hold its pieces while it predicts languages."""
    encoder = piece_cache.library_encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    assert list(encoder.texts(["some text"])) and encoder.known
    assert piece_cache.library_encoder.cache_info().currsize
    net = language_cnn.train(np.zeros((4, language_cnn.WINDOW), np.uint8), np.array([0, 1, 0, 1]), ["de", "en"])
    (classify,) = [c.cell_contents for c in language_cnn.classifier(net).__closure__]
    (found,) = classify.func(iter([pd.Series(["some text", None])]))
    assert list(found["lang_pred"])[1] == language_cnn.UNKNOWN
    assert not piece_cache.library_encoder.cache_info().currsize
