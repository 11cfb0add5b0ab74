"""Duplicates, languages and perspectives against plain versions on small tables."""

import collections
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import exact_dedup, language_cnn, perspectives, suffix_dedup, weighted_minhash
from seatwise.llm.suffix_array import permuted_prefixes, suffix_array


@pytest.mark.parametrize("capacity", [exact_dedup.CAPACITY, 3])
def test_exact_duplicates(odd_docs, no_docs, odd_texts, capacity):
    groups = collections.defaultdict(list)
    for k, t in enumerate(odd_texts):
        groups[t or ""].append(k)
    want = {
        (k, max(g), len(g), k == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g
    }
    found = list(map(tuple, exact_dedup.exact_duplicates(odd_docs, capacity=capacity).collect()))
    assert len(found) == len(want) and set(found) == want
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_exact_duplicates_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c")], "doc_id long, text string")
    kept = sorted((r["text"], r["doc_id"]) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert kept == [("a", 1), ("b", None), ("c", 2), ("c", 2)]


def test_overfull_buckets_are_split(spark):
    """The directory doubles as far as it has to; copies of one hash never split a bucket."""
    hashed = spark.range(4000).selectExpr("xxhash64(id) hash").union(spark.range(3000).selectExpr("7L hash"))
    for capacity in (100, 1):
        bits, slots = exact_dedup.directory(hashed, capacity)
        found = exact_dedup._in_buckets(hashed.distinct(), bits, slots)
        held = collections.Counter(r["bucket"] for r in found.collect())
        assert sum(held.values()) == 4001 and max(held.values()) <= capacity
        assert bits == exact_dedup.BITS if capacity == 100 else bits > 12
    bits, slots = exact_dedup.directory(hashed, 10**6)
    assert {r["depth"] for r in slots.collect()} == {0} and {r["bucket"] for r in slots.collect()} == {0}


def test_rows_are_found_through_the_directory(spark, odd_docs, monkeypatch):
    """Entries lie in their buckets in order of their owners; a wrong directory finds nothing."""
    index = exact_dedup.build_index(odd_docs, capacity=2)
    spans = index.entries.groupBy("bucket").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).collect()
    assert len(spans) > 5
    unsigned = lambda h: h % (1 << 64)
    for r in spans:
        assert unsigned(r["a"]) >> 64 - index.bits >= r["bucket"]
    rows = exact_dedup._hashed(odd_docs, "doc_id", "text").select("doc_id", "hash", F.unhex(F.sha2("text", 256)).alias("sha256"))
    assert exact_dedup.look_up(rows, index).count() == odd_docs.count()
    index.directory = index.directory.withColumn("bucket", F.col("bucket") + 1)
    assert exact_dedup.look_up(rows, index).count() == 0


def test_texts_of_one_hash_are_chained(spark, monkeypatch):
    named = lambda docs, i, t: docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(5).cast("long").alias("hash"))
    monkeypatch.setattr(exact_dedup, "_hashed", named)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "doc_id long, text string")
    assert sorted(r["chain"] for r in exact_dedup.build_index(docs).entries.collect()) == [1, 2, 3, 4]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert found == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 20])
        text = [rng.randint(1, letters) for _ in range(rng.randint(0, 60))] + [0]
        found = suffix_array(np.array(text, np.uint16))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert found.tolist() == order
        shared = permuted_prefixes(np.array(text, np.uint16), found, np.array([0]), 10**6)
        for one, two in itertools.pairwise(order):
            n = 0
            while text[one + n] == text[two + n]:
                n += 1
            assert shared[two] == n


def plain_repeats(texts):
    """(n_bytes, n_removed, n_spans, sha256) of texts in order."""
    seen, found = set(), []
    for text in texts:
        data, n = (text or "").encode(), suffix_dedup.LENGTH
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - n + 1):
            if data[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(data[i : i + n])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize("hot, shard", [(suffix_dedup.HOT, suffix_dedup.SHARD_BYTES), (1, 500), (3, 2000)])
def test_repeated_passages(monkeypatch, odd_docs, no_docs, odd_texts, hot, shard):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    found = {r[0]: tuple(r)[1:] for r in suffix_dedup.repeated_passages(odd_docs).collect()}
    assert found == dict(enumerate(plain_repeats(odd_texts)))
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("width", [1, 7, 30, suffix_dedup.SPAN])
def test_equal_windows_of_a_crowded_anchor_stay_together(width):
    """Windows are dealt out whole, each once, and equal ones under equal keys, in few rows."""
    rng = random.Random(14)
    passage = "".join(rng.choice("abcde ") for _ in range(300))
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 90))) + passage + rng.choice(["", "ab" * 40]) for _ in range(40)]
    keys, windows, rows, regions = {}, 0, 0, 0
    for text in (t.encode() for t in texts):
        for key, first, last, _ in zip(*suffix_dedup.anchors(text)):
            at, regions = int(first), regions + 1
            for own, begin, end in suffix_dedup.narrowed(text, int(key.view(np.int64)), at, int(last), width):
                assert begin == at and end >= begin
                for start in range(begin, end + 1):
                    keys.setdefault((int(key), text[start : start + suffix_dedup.LENGTH]), set()).add(own)
                at, windows, rows = end + 1, windows + end + 1 - begin, rows + 1
            assert at == last + 1
    assert all(len(own) == 1 for own in keys.values())
    assert rows <= windows / width + 2 * regions


@pytest.mark.parametrize("hot", [2, 9, 8000])
def test_one_passage_in_many_contexts(monkeypatch, spark, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(15)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(260)
    texts = [some(rng.randint(0, 150)) + passage[rng.randint(0, 3) :] + some(rng.randint(0, 150)) for _ in range(60)]
    texts += ["xy" * 300, "z" + "xy" * 200, passage + passage, passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert found == dict(enumerate(plain_repeats(texts)))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_rows_that_share_id_and_text_keep_the_text(monkeypatch, spark, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    one, two, three = (" ".join(str(rng.randint(0, 10**6)) for _ in range(40)) for _ in range(3))
    rows = [(2, one), (2, one), (None, two), (None, two), (None, two), (5, two), (6, one + three), (6, one + three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeated_passages(docs).collect())
    n, m, both = len(one), len(two), len(one + three)
    assert found == sorted([(0, m, 0)] * 3 + [(2, n, 0)] * 2 + [(5, m, m)] + [(6, both, n)] * 2)
    kept = suffix_dedup.remove_repeated_passages(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted([one] * 2 + [two] * 3 + [""] + [three] * 2)


def test_passages_cut_out_of_rows(spark):
    line = "é" * 30 + "".join(chr(97 + k % 26) + str(k) for k in range(60))
    docs = spark.createDataFrame(
        [(None, line, 0, "x"), (1, "b" + line, 0, "y"), (2, None, None, "z"), (3, "short", 5, "z")],
        "doc_id long, text string, n_chars int, runs string",
    )
    found = suffix_dedup.remove_repeated_passages(docs)
    assert found.schema.names == docs.schema.names and found.dtypes == docs.dtypes
    rows = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {None: (line, len(line), "x"), 1: ("b", 1, "y"), 2: (None, None, "z"), 3: ("short", 5, "z")}


def test_near_duplicates_that_stay(odd_docs, no_docs):
    classes = weighted_minhash.near_duplicate_classes(odd_docs).collect()
    stay = {r["doc_id"] for r in classes if r["kept"]}
    assert stay == {r["class_id"] for r in classes}
    kept = weighted_minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == stay
    assert weighted_minhash.near_duplicate_classes(no_docs).count() == 0


def test_near_duplicates_under_repeated_and_null_ids(spark):
    """Texts are linked whatever their ids; only a text that stands for its class stays."""
    rng = random.Random(12)
    texts = [[f"{k}w{rng.randint(0, 10**6)}" for _ in range(200)] for k in range(3)]
    a, b, c = (" ".join(t) for t in texts)
    near = lambda t: " ".join([*t[:100], "changed", *t[101:]])
    rows = [(1, a), (2, near(texts[0])), (2, b), (4, near(texts[1])), (None, near(texts[2])), (None, c), (7, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sha string")
    found = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in weighted_minhash.near_duplicate_classes(docs).collect()), key=str)
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (4, 2, False), (7, 7, True), (8, 7, False)]
    assert found[:6] == want and [f[:2] for f in found[6:]] == [(None, None)] * 2 and sum(f[2] for f in found[6:]) == 1
    left = weighted_minhash.drop_near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str)[:3] == [(1, a), (2, b), (7, "")] and len(left) == 4


def test_long_texts_are_compared_in_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "BLOCK_BYTES", 20_000)
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(60_000)]
    docs = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(6)] + [(9, "w1 w2")]
    found = weighted_minhash.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {**dict.fromkeys(range(6), 0), 9: 9}


def test_near_duplicates_go_to_python_in_small_batches(spark, monkeypatch):
    """However many rows a task has, and the setting of the session is as before afterwards."""
    key, sign, seen = "spark.sql.execution.arrow.maxBytesPerBatch", weighted_minhash.sign, []
    monkeypatch.setattr(weighted_minhash, "sign", lambda docs: seen.append(spark.conf.get(key)) or sign(docs))
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    for before in (None, "16m"):
        if before:
            spark.conf.set(key, before)
        was = spark.conf.get(key)
        assert {r["class_id"] for r in weighted_minhash.near_duplicate_classes(docs).collect()} == {1}
        assert spark.conf.get(key) == was
    spark.conf.unset(key)
    assert seen == ["8m", "8m"]


def test_weights_are_those_of_each_shingle(monkeypatch, spark):
    monkeypatch.setattr(weighted_minhash, "RANGE_BYTES", 100_000)
    monkeypatch.setattr(weighted_minhash, "BATCH", 150)
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 10**7)}" for _ in range(600)) for _ in range(500)]
    texts += [texts[0], texts[1] + " tail", " ", "", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    have = collections.Counter(h for t in texts for h in weighted_minhash.shingles([t])[1].tolist())
    assert len(have) > 1 << weighted_minhash.IDF_BITS
    signed, documents = weighted_minhash.sign(docs)
    found = {r["doc_id"]: r["frequency"] for r in signed.collect()}
    assert documents == len(texts) == len(found)
    for k, text in enumerate(texts):
        want = [np.log((1 + documents) / (1 + have[h])) + 1 for h in weighted_minhash.shingles([text])[1].tolist()]
        assert np.allclose(weighted_minhash._unpacked(found[k], documents), want)


def plain_near_classes(texts):
    """The first text of each text's class, by comparing all pairs with weights of their own."""
    plain = []
    for text in texts:
        words = (text or "").lower().split()
        n = max(1, len(words) - 4) if words else 0
        plain.append(collections.Counter(tuple(words[i : i + 5]) for i in range(n)))
    have = collections.Counter(s for p in plain for s in p)
    weight = lambda s: np.log((1 + len(plain)) / (1 + have[s])) + 1
    label = list(range(len(plain)))
    for a, b in itertools.combinations(label[:], 2):
        one, two = plain[a], plain[b]
        both = sum(n * weight(s) for s, n in (one & two).items())
        either = sum(n * weight(s) for s, n in (one | two).items())
        if (texts[a] or "") == (texts[b] or "") or both and both / either >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def test_near_duplicates_with_exact_weights(odd_docs, odd_texts):
    found = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicate_classes(odd_docs).collect()}
    assert found == dict(enumerate(plain_near_classes(odd_texts)))


def test_every_unicode_space_separates_words():
    plain = "Ä b c d e f g h i j k l m n o p q r s t u"
    _, want, _ = weighted_minhash.shingles([plain])
    for space in "\u0085\u00a0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\t\n":
        _, found, _ = weighted_minhash.shingles([plain.replace(" ", space)])
        assert found.tolist() == want.tolist()
    assert not len(weighted_minhash.shingles(["\u3000\u00a0"])[1])


def test_texts_with_an_accent_take_no_multiple_of_the_time():
    """One letter that is not ASCII does not have every letter of the text looked up."""

    def seconds(text: str) -> float:
        taken = []
        for _ in range(5):
            start = time.process_time()
            weighted_minhash.shingles([text])
            taken.append(time.process_time() - start)
        return min(taken)

    plain = "some words of a long text " * 40_000
    assert seconds("\u00e9 " + plain) < 2.5 * seconds(plain)


def test_samples_agree_as_often_as_the_weights_overlap():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(900)]
    rng.shuffle(words)
    one, two = " ".join(words[:600]), " ".join(words[150:750])
    idf = np.ones(1 << weighted_minhash.IDF_BITS)
    _, found = weighted_minhash.samples([one, two], idf)
    agree = np.mean(found[0] == found[1])
    assert abs(agree - 446 / 746) < 0.25


def test_blocks_of_similarities(monkeypatch, odd_texts):
    monkeypatch.setattr(weighted_minhash, "FEATURES", 64)
    idf = np.random.default_rng(1).uniform(1, 9, 1 << weighted_minhash.IDF_BITS)
    texts = [t or "" for t in odd_texts[6:24]] + ["a b c d e a b c d e a b c d e", "a b c d e a b c d e"]
    sets = []
    for text in texts:
        _, hashes, counts = weighted_minhash.shingles([text])
        sets.append((hashes, counts * idf[weighted_minhash._bucket(hashes)]))
    found = weighted_minhash.similarities(texts[:7], texts[7:], idf)
    want = [[weighted_minhash.weighted_jaccard(a, b) for b in sets[7:]] for a in sets[:7]]
    assert np.allclose(found, want)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    docs = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"x{k}"
        docs.append((k, " ".join(words)))
    docs += [(1000 + k, " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(300))) for k in range(100)]
    found = weighted_minhash.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    classes = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert all(classes[k] == 0 for k in range(400)) and all(classes[1000 + k] == 1000 + k for k in range(100))


def test_components_of_a_long_chain(spark):
    links = spark.range(40).selectExpr("id + 1 a", "id + 2 b")
    found = weighted_minhash.components(links).collect()
    assert len(found) == 41 and {r["label"] for r in found} == {1}


def test_languages(spark, odd_docs, no_docs):
    rng = random.Random(9)
    letters = {"aa": "abcde", "bb": "stuvw"}
    rows = []
    for k in range(300):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randint(20, 200)))
        rows.append((k, text, lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", "aa"), (1003, rows[0][1], None), (None, rows[1][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_cnn.identify_languages(docs).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (1000, 1001, 1002))
    held = [r for r in rows[:300] if found[r[0]]["held_out"]]
    assert np.mean([found[k]["lang_pred"] == lang for k, _, lang in held]) > 0.95 and len(held) > 40
    assert not found[None]["held_out"] and found[1003]["lang_pred"] == rows[0][2]
    assert {r["doc_id"] for r in language_cnn.keep_identified(docs).collect()}.isdisjoint({1000, 1001, 1002})
    assert language_cnn.identify_languages(no_docs).count() == 0
    assert language_cnn.identify_languages(odd_docs).count() == odd_docs.count()


def small_network(rng, labels=3):
    """Random weights in double precision."""
    wide, n = max(language_cnn.WIDTHS), language_cnn.FILTERS * len(language_cnn.WIDTHS)
    return language_cnn.Network(
        [f"l{k}" for k in range(labels)],
        rng.normal(0, 0.5, (256, language_cnn.EMBEDDED)),
        rng.normal(0, 0.3, (wide * language_cnn.EMBEDDED, n)) * language_cnn.filter_mask(),
        rng.normal(0, 0.1, n), rng.normal(0, 0.5, (n, labels)), rng.normal(0, 0.1, labels),
    )


def plain_probabilities(net, data):
    """One window, filter by filter and place by place."""
    size, hidden = language_cnn.EMBEDDED, []
    padded = list(data) + [0] * (max(language_cnn.WIDTHS) - 1)
    for f in range(len(net.bias)):
        width = language_cnn.WIDTHS[f // language_cnn.FILTERS]
        found = []
        for at in range(len(data)):
            found.append(sum(
                float(net.embedding[padded[at + k]] @ net.kernel[k * size : (k + 1) * size, f]) for k in range(width)
            ))
        hidden.append(max(0.0, max(found) + net.bias[f]))
    raw = [sum(h * net.weights[j, c] for j, h in enumerate(hidden)) + net.offset[c] for c in range(len(net.offset))]
    total = sum(np.exp(r) for r in raw)
    return [np.exp(r) / total for r in raw]


def test_network_is_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = small_network(rng)
    windows = rng.integers(0, 256, (4, 40)).astype(np.uint8)
    windows[1, 7:] = 0
    assert np.allclose(net.probabilities(windows), [plain_probabilities(net, w) for w in windows.tolist()])
    # a text over several windows: the mean of theirs, weighted by their bytes
    text = bytes(rng.integers(0, 256, 2 * language_cnn.WINDOW + 50).tolist())
    parts = [text[k : k + language_cnn.WINDOW] for k in range(0, len(text), language_cnn.WINDOW)]
    each = [plain_probabilities(net, part.ljust(language_cnn.WINDOW, b"\0")) for part in parts]
    mean = np.average(each, axis=0, weights=[len(part) for part in parts])
    (lang,), (score,) = language_cnn.predict_texts(net, [text])
    assert lang == net.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-9


def test_gradients_are_numeric_ones():
    rng = np.random.default_rng(4)
    net = small_network(rng)
    x, y = rng.integers(1, 256, (6, 30)).astype(np.uint8), rng.integers(0, 3, 6)
    mask = language_cnn.filter_mask()
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for name, found in language_cnn.gradients_of(net, x, y, mask).items():
        weights = getattr(net, name)
        places = [np.unravel_index(k, weights.shape) for k in np.argsort(-np.abs(found), axis=None)[:6]]
        for at in places:
            kept, step = weights[at], 1e-6
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert abs((up - down) / (2 * step) - found[at]) < 1e-5 + 1e-3 * abs(found[at]), name
    assert not (language_cnn.gradients_of(net, x, y, mask)["kernel"] * (1 - mask)).any()


def test_every_label_is_learned(spark, monkeypatch):
    """Also rare ones among very many, each with at least one document, whatever the bound on the sample."""
    rows = [(k, f"text {k} abc", f"l{k % 250:03d}") for k in range(1000)] + [(5000 + k, "rare words", "rare") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_cnn, "train", lambda windows, labels, languages: seen.append((windows, labels, languages)))
    for bound, per_label in [(120_000, 3), (100, 600)]:
        monkeypatch.setattr(language_cnn, "SAMPLE_DOCS", bound)
        language_cnn.fit(docs, per_language=per_label)
    labels = {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    most = [3, 1]
    for (windows, owners, languages), count in zip(seen, most):
        assert set(languages) == labels and len(labels) > 200
        drawn = np.bincount(owners) // language_cnn.WINDOWS_PER_DOC
        assert drawn.min() >= 1 and drawn.max() <= count


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(1, "some words", None), (2, "12 !?", None), (3, None, None), (4, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_cnn.keep_identified(docs).collect()) == [1, 4]


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"),
        (1, 3, None, "é", "x"), (2, None, "ann", "b", "x"), (2, None, "ann", "b", "x"), (3, 0, "system", "s", "x"),
        (None, 0, "ann", "n", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    found = {(r["conv_id"], r["perspective"]): r for r in perspectives.rotate_perspectives(turns).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "ann")}
    bob = found[1, "bob"]
    assert bob["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\né<|im_end|>\n"
    )
    assert [bob["text"][m["begin"] : m["end"]] for m in bob["mask"]] == ["<|im_end|>"]
    assert [found[2, "ann"]["text"][m["begin"] : m["end"]] for m in found[2, "ann"]["mask"]] == ["b<|im_end|>"] * 2
    assert perspectives.digests(perspectives.rotate_perspectives(turns.limit(0))).count() == 0


def test_a_long_conversation_is_rendered_in_blocks(spark):
    turns = spark.range(1000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'a', 'b') role", "string(id) text")
    found = sorted(perspectives.rotate_perspectives(turns).where("perspective = 'a'").collect(), key=lambda r: r["block"])
    assert [r["n_turns"] for r in found] == [256, 256, 256, 232]
    said = "".join(r["text"] for r in found)
    assert [int(p.split("<")[0]) for p in said.split("\n")[1::2]] == list(range(1000))
