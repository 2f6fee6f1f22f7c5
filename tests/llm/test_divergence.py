from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import divergence, queries
from tidemark.llm.sql import SQL

ROW = "text string, lang string, source string"


def slow(rows, least=3, top=200):
    """Sorted (lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_odd_rows(spark):
    rows = [(cases.words(30, i % 7), "en", f"s{i % 4}") for i in range(24)]
    rows += [("Ünder ÉCLAIR éclair x1y2z the The THE", "de", s) for s in "aab"] + [("the the the", "de", None), (None, None, None), ("", "en", "empty"), ("12 34", "en", "digits")]
    rows += [("rare words only", "fr", "one"), ("", "fr", "two"), ("a a a", None, "x"), ("a b", None, "y"), ("a", "", "x")]
    docs = spark.createDataFrame(rows, ROW).repartition(4).withColumn("n", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("term", F.lit("y"))
    assert found(divergence.source_divergence(docs)) == slow(rows)
    assert divergence.source_divergence(spark.createDataFrame([], ROW)).collect() == []


def test_many_shards_and_a_term_in_all_documents(spark, monkeypatch):
    rows = [(f"common common {cases.words(25, i % 11)} {'hot ' * (i % 5)}", "en" if i % 3 else "de", f"s{i % 5}") for i in range(90)]
    monkeypatch.setattr(divergence, "SHARD_BYTES", 500)
    assert found(divergence.source_divergence(spark.createDataFrame(rows, ROW).repartition(6), top=7)) == slow(rows, top=7)


def test_tasks_give_counts_out_before_they_hold_too_many(spark):
    rows = [(cases.words(60, i % 9), "en", f"s{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, ROW).coalesce(1).select("lang", "source", F.col("text").alias("t"))
    counts = divergence.local_counts(docs).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    want, docs_of = Counter(), Counter()
    for text, _, _ in rows:
        want.update(text.split())
        docs_of.update(set(text.split()))
    assert {(r.term, r.n, r.docs) for r in counts.collect()} == {(t, n, docs_of[t]) for t, n in want.items()}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = found(queries.op13_source_divergence(spark, sf))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        assert got == sorted(db.execute(SQL["op13_source_divergence"]).fetchall())
