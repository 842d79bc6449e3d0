"""Small awkward tables for the tests of the corpus operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, score string, slot int, length string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def awkward():
    """Rows (doc_id, text): nulls, empty and very long texts, ties, repeated rows, null ids."""
    rng = random.Random(1)
    base, other = prose(rng, 80), prose(rng, 60)
    near = base.rsplit(" ", 3)[0]
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one two"), (4, "ONE two"), (5, base), (6, base.upper()), (7, near), (8, other), (8, other), (9, other + " " + base), (None, near), (None, None)]
    return [*rows, (10, prose(rng, 30_000)), (11, "wort " * 400), (12, "é" * 50 + " ünïcödé 漢字 🙂 text with more than twenty words so that it is not rejected for being short " * 2), (13, other.lower())]


def table(spark, rows=None):
    """The documents table, with extra columns whose names the operators also give to their results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, None, "x", "y", 1, "z") for i, t in (awkward() if rows is None else rows)], SCHEMA)
