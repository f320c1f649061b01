from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, `a.b` string, _k long, size string, n string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under pale moonlight near old stones".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with more columns whose names clash with helpers'."""

    def build(rows):
        full = [(*r, *(None, None)[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame([(d, t, a, s, None, 7, "x", 8, "y", "z") for d, t, a, s in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, equal texts, very long texts, other scripts, special tokens."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 50), "en", "a"), (2, prose(2, 50), "en", "a"), (2, prose(2, 50), "en", "a"), (None, prose(3, 40), "en", None), (None, None, None, None),
        (3, None, "en", "b"), (4, "", "en", "b"), (5, " \t\n", None, "b"), (6, "w" * 300_000, "de", "c"), (7, long, "en", "a"), (8, long + " end", "en", "a"),
        (9, "Ünïcode 漢字 🙂 e\u0301\x1c\u00a0x <|endoftext|> OK", "fr", "é"), (10, "one two", "en", "a"), (11, "One TWO", "en", "z"), (12, "12 34 !?", "en", "a"), (-3, "un deux trois quatre cinq six", "fr", "b"),
    ]
