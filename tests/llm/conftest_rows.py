"""Rows for the corpus tests."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, word string, k1 long, kind string, "
    "place int, bucket long, size long, label string"
)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def line(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, "x", 2, "k", 3, 4, 5, "l")
