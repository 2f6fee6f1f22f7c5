from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import queries, repeats
from tidemark.llm.sql import SQL


def slow(rows, k=13):
    """Sorted (id, n_words, n_removed, digest) of rows (id, text)."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        for s in range(len(w) - k + 1 if i is not None else 0):
            win = tuple(w[s : s + k])
            least[win] = min(i, least.get(win, i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - k + 1 if i is not None else 0):
            if least[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def check(spark, rows, k=13, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = found(repeats.remove_repeats(docs, k))
    assert got == slow(rows, k)
    return got


def passages():
    base = [cases.words(80, 900 + i) for i in range(4)]
    rows = []
    for i in range(40):
        p = base[i % 4].split()
        cut = p[(3 * i) % 30 : 30 + (7 * i) % 50]
        rows.append((1000 - 7 * i, f"{cases.words(15, i)} {' '.join(cut)} {cases.words(9, 50 + i)}"))
    rows += [(2000 + i, base[0]) for i in range(6)] + [(3, base[0] + " " + base[1]), (4, base[1] + "  \n" + base[0])]
    return rows


def test_shared_passages_copies_and_chains(spark):
    rows = passages()
    got = check(spark, rows)
    assert sum(r[2] for r in got) > 500
    check(spark, rows, 13, 1)


def test_periodic_texts_ties_and_short_windows(spark):
    rows = [(i, "the the " * (10 + i)) for i in range(8)] + [(20 + i, "a b c " * (3 + i)) for i in range(8)]
    rows += [(40, "x " * 12), (41, "x " * 12), (42, "x " * 13), (43, "x " * 13), (44, "x"), (45, " "), (46, ""), (47, None)]
    check(spark, rows)
    for k in (2, 3, 5):
        check(spark, rows, k)
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1)


def test_odd_rows_and_clashing_names(spark):
    """Nulls, repeated rows, ids that repeat with other texts, rows without an id, names that the operator uses itself."""
    extra = [(i, cases.words(40, 1000), "en", "s", 1, "x", "y", "z", "w", 1) for i in (200, 90, None)]
    extra += [(103, cases.words(40, 1000) + " end of it", "en", "s", 1, "x", "y", "z", "w", 1), (103, cases.words(60, 77), "en", "s", 1, "x", "y", "z", "w", 1)]
    docs = cases.documents(spark, 12, extra)
    docs = docs.unionByName(docs).withColumn("n", F.lit(1)).withColumn("path", F.lit("p")).withColumn("key", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(repeats.remove_repeats(docs)) == slow(rows)
    assert repeats.remove_repeats(cases.empty(spark)).collect() == []
    assert repeats.repeated_spans(cases.empty(spark)).collect() == []


def test_windows_of_words_that_a_polynomial_hash_confuses_differ(spark):
    one, other = ("".join("ab"[(bin(i).count("1") + f) % 2] for i in range(1 << 11)) for f in (0, 1))
    around = cases.words(12, 3)
    got = check(spark, [(1, f"{around} {one}"), (2, f"{around} {other}"), (3, f"{one} {around} {other}")])
    assert [r[2] for r in got] == [0, 0, 13]


def test_a_failed_comparison_is_done_again(spark, monkeypatch):
    """Places whose source has other words, as hashes that collide would give, are not removed: all is done with another seed."""
    real, seeds = repeats.repeated_places, []

    def wrong(docs, scratch, k, seed, *columns):
        seeds.append(seed)
        places = real(docs, scratch, k, seed, *columns)
        return places.withColumn("src_pos", F.col("src_pos") + 1) if seed == 1 else places

    monkeypatch.setattr(repeats, "repeated_places", wrong)
    check(spark, passages()[:12])
    assert seeds == [1, 2]


def test_spans_have_their_source_and_paths(spark):
    rows = passages()
    words = {i: t.split() for i, t in rows}
    spans = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    covered = {}
    for s in spans:
        assert s.source_id < s.doc_id and s.n_words >= 13
        assert words[s.doc_id][s.start : s.start + s.n_words] == words[s.source_id][s.source_start : s.source_start + s.n_words]
        covered.setdefault(s.doc_id, set()).update(range(s.start, s.start + s.n_words))
    assert {(r[0], r[2]) for r in slow(rows) if r[2]} == {(i, len(c)) for i, c in covered.items()}
    # A passage that nothing branches off is one path wherever it occurs; different words are different paths.
    at = {}
    for s in spans:
        for j in range(s.n_words - 12):
            at.setdefault(tuple(words[s.doc_id][s.start + j : s.start + j + 13]), set()).add(s.path)
    assert all(len(p) == 1 for p in at.values()) and len({s.path for s in spans}) < len(spans)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op11_substring_dedup(spark, sf).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        assert got == sorted(db.execute(SQL["op11_substring_dedup"]).fetchall())
