"""Small document tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, bucket long, hash string, size long, kept boolean, n long, id long, word string, block string, line string"
WORDS = ["time", "Year", "people", "way", "day", "man", "thing", "woman", "life", "child", "world", "school", "Straße", "état", "niño", "hand", "part", "place", "case", "week", "company", "system"]


def frame(spark, rows, parts: int = 3):
    """``rows``: (doc_id, text[, lang[, source]]); the other columns hold values that an operator must not mistake for its own."""
    full = []
    for k, r in enumerate(rows):
        doc_id, text, lang, source = (tuple(r) + (None, None))[:4]
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, "x", k % 3, 7, "h", 5, False, 9, 11, "w", "b", "l"))
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(words))


def awkward(rng: random.Random) -> list[tuple]:
    base = sentence(rng, 60)
    long = "\n".join(sentence(rng, 12) for _ in range(900))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (5, base), (6, base + " "), (None, base), (None, None), (7, long), (8, long), (9, "a"), (10, "A"), (11, "one two"),
        (12, " x y"), (13, "line one is long enough to count\nline two is long enough to count\nline one is long enough to count"), (14, "😀 emoji 😀 text with four byte characters"), (15, "no\0nul"),
    ]
