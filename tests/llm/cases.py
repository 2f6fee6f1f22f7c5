"""Small tables with odd rows: nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, score string, t string, rank int"
LABELS = "doc_id long, quality int, toxic int, k string"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, n: int = 30, extra: list[tuple] = ()):
    rows = [(i, words(20 + i * 3, i), "en", "s", 1, "x", "y", "z", "w", 3) for i in range(n)]
    odd = [
        (100, None, None, None, None, None, None, None, None, None),
        (101, "", "en", "s", 0, "x", "y", "z", "w", 1),
        (102, " \n\t ", "en", "s", 0, "x", "y", "z", "w", 1),
        (None, words(40, 5), "en", "s", 0, "x", "y", "z", "w", 1),
        (None, None, None, None, None, None, None, None, None, None),
        (103, words(40, 1000), "de", "s", 0, "x", "y", "z", "w", 1),
        (103, words(40, 1000), "de", "s", 0, "x", "y", "z", "w", 1),
        (104, "one", "fr", "s", 0, "x", "y", "z", "w", 1),
        (105, words(20_000, 3), "fr", "s", 0, "x", "y", "z", "w", 1),
    ]
    return spark.createDataFrame([*rows, *odd, *extra], DOCS).repartition(3)


def labels(spark, n: int = 30):
    rows = [(i, int(i % 4 != 0), int(i % 7 == 0), "a") for i in range(n)]
    return spark.createDataFrame([*rows, (None, 1, 0, None), (3, None, None, None), (100, 1, 0, "b"), (7777, 0, 1, "c")], LABELS)


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)


def key(rows, *names):
    """Rows as sorted tuples, None before all else."""
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda t: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in t))
