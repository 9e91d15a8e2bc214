"""Small tables with awkward rows, and slow but plain versions of what operators compute."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _score double, owner string, mark string"


def documents(spark, rows):
    """``rows``: ``(doc_id, text, source)``; the table has clashing extra columns too."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, "x", "y") for i, t, s in rows], DOCUMENTS)


def awkward():
    """Null id, null, empty and blank texts, a repeated row, one id with two texts, a long text, odd characters."""
    return [
        (None, "a b c d e f g", "s1"), (1, None, "s1"), (2, "", None), (3, " \t\n ", "s2"), (4, "one two", "s2"),
        (4, "one two", "s2"), (5, "first text of five", "s1"), (5, "second text of five with more", "s1"),
        (6, "w " * 60_000, "s3"), (7, "é ß 😀 x y", None), (8, "ONE Two", "s3"),
    ]


def prose(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


class Groups:
    """Union-find whose groups are named by their smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
