from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tidemark.llm import near_copies


def slow_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_groups(texts):
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b) > 0):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def variants(seed, n, edits):
    """Texts that differ from one another by replaced words."""
    base = cases.words(150, seed).split()
    out = []
    for i in range(n):
        w = list(base)
        for e in range(edits):
            w[(37 * i + 53 * e) % len(w)] = f"new{i}x{e}"
        out.append(" ".join(w))
    return out


def check(spark, texts, bucket):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in near_copies.keep_one(docs, bucket=bucket).collect())
    assert got == sorted(set(slow_groups(texts)))
    return got


def test_similar_texts_are_one_group(spark):
    texts = [t for k, edits in enumerate((0, 1, 2, 3, 4)) for t in variants(k, 4, edits)]
    texts += [None, "", " \n", "one", "One", "one two", "two one", "a b c d", "a b c d e", "a  b\nc D e", cases.words(3000, 99), cases.words(3000, 99) + " end"]
    kept = check(spark, texts, 32)
    assert len(kept) < len(texts)


def test_crowded_items_link_the_same_groups(spark):
    check(spark, variants(7, 60, 1) + variants(8, 5, 2), 8)


def test_left_over_sets_and_common_passages_link_the_same_groups(spark):
    """A large group whose least set is not linked to all of it, chains of links, and passages that many other texts share."""
    texts = variants(11, 40, 3) + variants(11, 20, 6)
    chain = cases.words(200, 12).split()
    for k in range(14):
        chain = chain[:]
        chain[10 + 13 * k] = f"link{k}"
        texts.append(" ".join(chain))
    passage = cases.words(60, 13)
    texts += [f"{cases.words(60, 500 + i)} {passage}" for i in range(30)]
    texts += [f"{passage} {cases.words(8, 700 + i)}" for i in range(12)]
    kept = check(spark, texts, 4)
    assert len(kept) < len(texts)


def test_repeated_rows_and_clashing_names(spark):
    docs = cases.documents(spark, 8)
    extra = docs.withColumn("row_key", F.lit(1)).withColumn("row_key_", F.lit("a"))
    got = near_copies.keep_one(extra.unionByName(extra))
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 100) == list(range(8))
    assert [r.doc_id for r in rows if r.doc_id == 103] == [103] and not [r for r in rows if r.doc_id is None and r.text is None]
    assert near_copies.keep_one(cases.empty(spark)).collect() == []


def test_stage_drops_copies_beyond_two_bits(spark):
    texts = variants(3, 3, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tidemark.llm import simhash

    assert simhash.keep_one(docs).count() == 3
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def thue_morse(bits, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1 << bits))


def test_words_that_a_polynomial_hash_confuses_are_no_copies(spark):
    """A Thue-Morse word and its complement are equal to any polynomial hash modulo 2^64."""
    one, other = thue_morse(11), thue_morse(11, True)
    around = [cases.words(3, s) for s in (31, 32)]
    texts = [one, other, *(f"{around[0]} {w} {around[1]}" for w in (one, other)), f"{around[0]} {one} {around[1]}"]
    assert check(spark, texts, 32) == [0, 1, 2, 3]


def test_long_sets_of_unlike_lengths_are_told_apart(spark):
    """Sets whose marks have more than the least bits, of one length and of two."""
    long = cases.words(2400, 21).split()
    texts = [" ".join(long), " ".join(long[:2030]), " ".join(long[300:]), " ".join([*long[:1200], *cases.words(1200, 22).split()]), " ".join(long[:1100]), " ".join(long[:1000])]
    check(spark, texts, 2)


def test_crowds_of_chains_link_the_same_groups(spark):
    """Random chains of edits that cross one another around common passages, where nearly every element is crowded: sets join the largest component at
    different times, and each has several others to see."""
    import random

    rng = random.Random(6)
    texts = []
    for family in range(3):
        base = cases.words(70, 60 + family).split()
        made = [base]
        for k in range(24):
            w = list(rng.choice(made))
            for _ in range(rng.choice([1, 1, 2])):
                w[rng.randrange(len(w))] = f"f{family}k{k}x{rng.randrange(99)}"
            made.append(w)
        texts += [" ".join(w) for w in made]
    rng.shuffle(texts)
    kept = check(spark, texts, 2)
    assert 3 < len(kept) < len(texts)
