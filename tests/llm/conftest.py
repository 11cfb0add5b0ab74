import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string"


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, blank, short, long and repeated texts; near copies; shared passages; odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(200), text(40)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " ", "a", "  two  spaces ", "it's 12 — é漢😀\n\tx", base, base, " ".join(near), base.upper()]
    texts += [text(30) + " " + passage + " " + text(30) for _ in range(4)]
    texts += [text(5) + "\n" + passage, "ab" * 400, "ab" * 400, "x" * 5000, text(6000), "<|endoftext|> | a|b |"]
    texts += [text(rng.randint(1, 80)) for _ in range(20)] + [None, ""]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns whose names clash with the operators' own, in several partitions."""
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or ""), "h", "r") for k, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
