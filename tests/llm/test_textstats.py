"""The statistics of texts against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tests.llm import cases
from tidemark.llm import quality_rules
from tidemark.llm.common import buffers
from tidemark.llm.textstats import NAMES, STOP_WORDS, SYMBOLS, statistics, with_stats


def plain(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", t) if w]
    lines = [x for x in t.split("\n") if x]
    capital = sum("A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") for c in t)
    c, n = max(1, len(t)), max(1, len(words))
    end = t.rstrip(" \t\n\v\f\r")[-1:]
    return [
        len(t), len(words), len(t) / n, sum(x in SYMBOLS.decode() for x in t) / c, capital / c,
        sum(x in "0123456789" for x in t) / c, len(set(words)) / n,
        len(set(words) & set(STOP_WORDS)) / min(n, len(STOP_WORDS)), len(lines) / n,
        len(set(lines)) / max(1, len(lines)), t.count(".") / n, float(end != "" and end in ".!?"),
    ]


def test_statistics_match_plain_python():
    rng = random.Random(4)
    bits = ["the", "The", "der", " ", " ", "\n", "\n\n", "\t", "é", "É", "×", "ß", "7", "!", ".", "?", "$$", "日本", "x", " ", "\r\n", "_a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", " ", "\n", "end.", "end. \n", "É", "the the\nthe the\n" * 500]
    got = statistics(*buffers(pa.array(texts)))
    assert np.allclose(got, [plain(t) for t in texts])


def test_statistics_keep_columns_with_clashing_names(spark):
    docs = cases.documents(spark)
    got = with_stats(docs, "text", "s_")
    assert got.columns == docs.columns + ["s_" + n for n in NAMES]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.allclose([r["s_" + n] for n in NAMES], plain(r.text))


def test_good_only_counts_texts_once(spark):
    """The filter on the score isn't pushed below what counts the texts."""
    plan = quality_rules.good_only(cases.documents(spark), cases.labels(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("Filter") < plan.index("MapInArrow")


def test_sample_of_repeated_ids_is_bounded(spark):
    """A labelled id that many rows repeat brings at most twice `sample` rows to the driver, and the rest of the labels in."""
    rows = [(1, f"text {i} of the hot id") for i in range(500)] + [(i, f"other text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen = []
    fit = quality_rules.fit_rules
    quality_rules.fit_rules = lambda x, y, names: seen.append(len(y)) or fit(x, y, names)
    try:
        quality_rules.train(docs, labels, sample=30)
    finally:
        quality_rules.fit_rules = fit
    assert 1 <= seen[0] <= 60
