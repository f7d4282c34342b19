from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


def prose(n, seed, words=400):
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 8))) for _ in range(words)]
    return " ".join(g.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null ids, languages and sources, repeated rows, a very long text, other scripts, clashing columns."""
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n ", None, None), (None, "a b c d e f g", "en", None), (None, None, None, None), (4, "!!! ###", "de", "t"),
        (5, "same words here again and again", "en", "s"), (5, "same words here again and again", "en", "s"), (6, "one", "en", "s"), (7, "日本語 текст Ünï K \U0001f600", "fr", "t"),
        (8, "line\n\nline\nline", "en", "u"), (9, prose(60_000, 3), "en", "s"), (10, "x" * 50_000, "en", "s"), (11, "<|endoftext|> MIT License", "en", "s"), (12, "a\0b \0", "en", "s"),
    ]
    d = frame(spark, rows)
    from pyspark.sql import functions as F

    return d.withColumns({c: F.lit("clash") for c in ("kept", "_t", "_h", "_r", "_drop", "_gone", "size", "shard", "held_out", "score", "toxic", "piece", "id", "lines_found")})


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
