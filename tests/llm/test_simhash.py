from __future__ import annotations

import re

import xxhash

from tests.llm import cases
from tidemark.llm import simhash
from tidemark.llm.common import Scratch


def slow_fingerprint(text, shingle=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance):
    """Least position reachable over fingerprints at most `distance` bits apart."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \n", "one", "Two Words", "a b c", "Ä b C d\x0be f", cases.words(500, 2)):
        for shingle in (3, 5):
            assert simhash.fingerprint((text or "").encode(), shingle) == slow_fingerprint(text, shingle)


def test_groups_match_brute_force(spark):
    near = [(200 + i, cases.words(400, 9) + (f" tail{i}" if i else ""), "en", "s", 0, "x", "y", "z", "w", 1) for i in range(12)]
    docs = cases.documents(spark, extra=near)
    got = simhash.simhash_groups(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    group = slow_components(prints, 2)
    least = {}
    for r, g in zip(rows, group):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = [{"doc_id": r.doc_id, "fingerprint": f"{p:016x}", "component_id": least.get(g)} for r, p, g in zip(rows, prints, group)]
    assert cases.key(got, "doc_id", "fingerprint", "component_id") == cases.key(want, "doc_id", "fingerprint", "component_id")


def test_links_of_a_crowded_bucket_match_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {0, 1, 3, 2**64 - 1}
    for b in base:
        for _ in range(150):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randint(0, 63)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for distance in (1, 2):
        prints = spark.createDataFrame([(v,) for v in signed], "fp long")
        for bucket in (4, 10_000):
            with Scratch(spark, "test") as scratch:
                found = simhash.components(simhash.links(prints, scratch, distance, bucket), scratch).collect()
            root = {r.node: r.root for r in found}
            groups = slow_components(values, distance)
            mine = [root.get(s, s) for s in signed]
            assert len(set(zip(groups, mine))) == len(set(groups)) == len(set(mine))


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with Scratch(spark, "test") as scratch:
        got = simhash.components(edges, scratch).collect()
    assert {r.root for r in got} == {0} and len(got) == 201


def test_keep_one_keeps_columns_and_least_ids(spark):
    docs = cases.documents(spark)
    got = simhash.keep_one(docs).collect()
    assert simhash.keep_one(docs).columns == docs.columns
    ids = [r.doc_id for r in got]
    assert ids.count(103) == 1 and ids.count(100) == 1 and 101 not in ids and 102 not in ids
    assert {r.text for r in got if r.doc_id is None} == {cases.words(40, 5)}
    assert set(range(30)) <= set(ids)


def test_empty_table(spark):
    assert simhash.simhash_groups(cases.empty(spark)).collect() == []
    assert simhash.keep_one(cases.empty(spark)).collect() == []


def test_keys_of_fingerprints_are_never_broadcast(spark):
    """Exploded tables look as small as what they are exploded from: no join with one of them may go by Spark's estimate."""
    plans = []

    class Kept(Scratch):
        def write(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, name)

    prints = spark.createDataFrame([(v,) for v in range(200)], "fp long")
    for distance in (1, 2):
        with Kept(spark, "test") as scratch:
            found = simhash.links(scratch.write(prints, "prints"), scratch, distance)
            plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) == 4 and not any("Broadcast" in p for p in plans)
