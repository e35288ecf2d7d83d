"""Small tables with everything that can go wrong in one."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double, kept boolean, h string"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def text(n, seed):
    return " ".join(words(n, seed))


def frame(spark, rows):
    """Rows of (doc_id, text); the other columns clash with names that operators use and hold nulls."""
    return spark.createDataFrame([(i, t, None, "src0", None, "x", None, None, None) for i, t in rows], SCHEMA)


def odd_rows():
    long = text(30000, 5)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two\tthree"), (6, "One  two\nthree"), (7, long), (8, long + " end"), (9, long),
        (10, "É" * 70), (11, "É" * 70), (12, "   x\x1c\x85y"), (13, "\U0001F600 ok" * 30), (14, "a" * 5000),
    ]


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
