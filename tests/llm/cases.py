"""Small documents with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, component string, at int, score string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "stone", "river", "light", "garden", "quiet", "letter", "window", "harbour", "seven"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def edited(text: str, every: int, word: str = "changed") -> str:
    return " ".join(w if (i + 1) % every else f"{word}{i}" for i, w in enumerate(text.split(" ")))


def documents(spark, texts):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, lang)`` beside columns whose names the library uses inside."""
    rows = [(x[0], x[1], x[2] if len(x) > 2 else "en", "s", 1, "k", 7, "c", 0, "z") for x in texts]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    base = prose(1, 300)
    return documents(spark, [
        (1, base), (2, base), (2, base), (3, edited(base, 60)), (4, None), (5, ""), (6, " \t\n"), (7, "one"),
        (8, "one two"), (9, prose(2, 40_000)), (10, prose(3, 200)), (None, base), (None, None), (11, "x" * 70_000), (12, prose(4, 80)),
        (12, prose(5, 80)), (13, "ONE  two"), (14, "é" * 3 + " naïve"),
    ])
