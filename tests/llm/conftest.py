from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key_a string, grp int, n_words string, score string, `a.b` string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n invented words in sentences and lines."""
    import random

    rng, out = random.Random(seed), []
    for i in range(n):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(3)) + str(rng.randrange(vocabulary))
        out.append(w + (". " if i % 9 == 8 else " ") + ("\n" if i % 27 == 26 else ""))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with extra columns whose names operators might use themselves."""

    def make(texts, lang="en", source="s"):
        rows = []
        for i, t in enumerate(texts):
            i, t = t if isinstance(t, tuple) else (i, t)
            rows.append((i, t, lang, source, None if t is None else len(t), "r", "k", 7, "w", "x", "y"))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(5, 30_000)
    rows = [
        (None, None, None, None, None, None, None, None, None, None, None),
        (1, None, "en", "s", None, "r", "k", 7, "w", "x", "y"),
        (2, "", "en", None, 0, "r", "k", 7, "w", "x", "y"),
        (3, " \n\t\r ", None, "s", 5, "r", "k", 7, "w", "x", "y"),
        (4, long, "en", "s", len(long), "r", "k", 7, "w", "x", "y"),
        (4, long, "en", "s", len(long), "r", "k", 7, "w", "x", "y"),
        (None, "one two three", "en", "s", 13, "r", "k", 7, "w", "x", "y"),
        (5, "one two three", "en", "s", 13, None, None, None, None, None, None),
        (6, "one two three", "en", "s", -4, "r", "k", 7, "w", "x", "y"),
        (7, "!!! ... ###", "en", "s", 11, "r", "k", 7, "w", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)
