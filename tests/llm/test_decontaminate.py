from __future__ import annotations

import hashlib
import re

import pytest

from tests.llm import cases
from tidemark.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, window=10):
    wins = []
    for item, text in items:
        w = split(text)
        if w:
            wins += [(None if item is None else str(item), w[i : i + window]) for i in range(max(1, len(w) - window + 1))]
    for doc, text in rows:
        w = split(text)
        hit, found = set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {item} - {None}
        yield {"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)}


@pytest.fixture(scope="module")
def tables(spark):
    passage = cases.words(25, 77)
    extra = [
        (200, f"{cases.words(5, 1)} {passage.upper()}. {cases.words(5, 2)} {passage}", "en", "s", 0, "x", "y", "z", "w", 1),
        (201, " ".join(passage.split()[3:15]) + " " + " ".join(passage.split()[9:20]), "en", "s", 0, "x", "y", "z", "w", 1),
        (202, " ".join(passage.split()[:9]), "en", "s", 0, "x", "y", "z", "w", 1),
        (206, f"x {cases.words(20, 3)} y", "en", "s", 0, "x", "y", "z", "w", 1),
        (203, "Straße-ÉTÉ 12 a b", "en", "s", 0, "x", "y", "z", "w", 1),
        (204, "the the the the the the the the the the the the", "en", "s", 0, "x", "y", "z", "w", 1),
        (205, f"{passage}", "en", "s", 0, "x", "y", "z", "w", 1), (205, f"{passage}", "en", "s", 0, "x", "y", "z", "w", 1), (None, passage, "en", "s", 0, "x", "y", "z", "w", 1),
    ]
    docs = cases.documents(spark, 10, extra)
    items = [(1, passage), (10, passage), (2, "straße ÉtÉ 12"), (3, None), (4, ""), (5, "the " * 11), (None, cases.words(20, 3)), (6, "one"), (7, cases.words(30, 555))]
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("x", "y"), items


@pytest.mark.parametrize("most", [200_000, 7])
def test_matches_brute_force(spark, tables, most):
    docs, bench, items = tables
    got = decontaminate.decontaminate(docs, bench, max_windows=most).collect()
    want = list(brute([(r.doc_id, r.text) for r in docs.collect()], items))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert cases.key(got, *names) == cases.key(want, *names)
    assert sum(r.contaminated for r in got) >= 7


def test_clean_only_drops_the_hit_rows(spark, tables):
    docs, bench, items = tables
    bad = {(r["doc_id"]) for r in brute([(r.doc_id, r.text) for r in docs.collect()], items) if r["contaminated"]}
    kept = decontaminate.clean_only(docs, bench)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not ({i for i in ids if i is not None} & bad)
    assert len(ids) == docs.count() - sum(r["contaminated"] for r in brute([(r.doc_id, r.text) for r in docs.collect()], items))


def test_windows_of_items_without_an_id_are_hits(spark, tables):
    docs, bench, _ = tables
    row = decontaminate.decontaminate(docs, bench).filter("doc_id = 206").first()
    assert row.n_hit == 20 and row.n_items == 0 and row.contaminated
    for most in (200_000, 7):
        assert decontaminate.clean_only(docs, bench, max_windows=most).filter("doc_id = 206").count() == 0


def test_empty_tables(spark, tables):
    docs, bench, _ = tables
    assert decontaminate.decontaminate(cases.empty(spark), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, none).collect())
