"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over word shingles. Two of them that differ in at most two bits agree to within
one bit in one of two 32-bit segments; so each fingerprint is put once into a table for each segment, and
looks up, in each, its own value and the values one bit away. Matches are verified on all 64 bits.

A table entry that many fingerprints share (a large group of near copies) would give a square number of
matches. Fingerprints that meet such an entry are linked by another exact way: two fingerprints within two
bits have a common point at most one bit away from both, so each gives its 65 points, and those who share a
point are linked to the least of them. That is linear in the group, and loses and adds no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, buffers, fresh, map_texts, materialise, text_of

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text (UTF-8); 0 where it has no words."""
    words = [w for w in text.translate(LOWER).split(b" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        at = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
        digest = xxhash.xxh64_intdigest
        starts, ends = at[:n].tolist(), (at[shingle : shingle + n] - 1).tolist()
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, h, fp): for each row a hash of its text, and the fingerprint of its whole text as a signed 64-bit number. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(2))
            raw, at = data.tobytes(), at.tolist()
            seen: dict[bytes, int] = {}
            out = np.empty(b.num_rows, dtype=np.uint64)
            for i in range(b.num_rows):
                text = raw[at[i] : at[i + 1]]
                if text not in seen:
                    seen[text] = fingerprint(text, shingle)
                out[i] = seen[text]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], names=["id", "h", "fp"])

    text = text_of(text_col)
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")), run, "id long, h long, fp long")


def _segment(col, k: int):
    return F.shiftrightunsigned(col, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def _keys(fp, probes: bool):
    """Keys (segment number over segment value) of a fingerprint. Of two values one bit apart, one has a set bit more:
    it is enough that probes clear each set bit in turn."""
    out = []
    for k in range(2):
        tag = F.lit(k << 32)
        value = _segment(fp, k)
        own = F.array(value + tag)
        if probes:
            bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(value, i) == 1)
            own = F.concat(own, F.transform(bits, lambda i: value - F.call_function("shiftleft", F.lit(1).cast("long"), i) + tag))
        out.append(own)
    return F.explode(F.concat(*out))


def links(prints: DataFrame, scratch: Scratch, distance: int = 2, bucket: int = 32) -> DataFrame:
    """(a, b) with a < b for distinct fingerprints (column fp) at most two bits apart: every pair whose table entry is small, and
    for the rest a star that connects the same fingerprints. distance is 1 or 2.

    Keys and points are many rows of each fingerprint, but Spark sizes them as one, so that it would broadcast tables that the
    driver can't hold: they are joined by sort and merge, whatever their size."""
    if distance not in (1, 2):
        raise ValueError("two segments with balls of one bit find distances of 1 and 2")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    flip = lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    table = prints.select(F.col("fp").alias("b"), _keys(F.col("fp"), False).alias("k"))
    probe = prints.select(F.col("fp").alias("a"), _keys(F.col("fp"), True).alias("k"))
    # Probes are made once: each with the size of the table entry that it meets, if any.
    size = table.groupBy("k").agg(F.count("*").alias("n"))
    met = scratch.write(probe.join(size.hint("merge"), "k"), "met")
    pairs = (
        met.filter(F.col("n") <= bucket).select("a", "k").join(table.hint("merge"), "k")
        .filter((F.col("a") != F.col("b")) & near("a", "b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    # Each entry's own fingerprints are among those that meet it.
    crowd = scratch.write(met.filter(F.col("n") > bucket).select(F.col("a").alias("fp")).distinct(), "crowd")
    if distance == 2:
        ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), flip))
        points = crowd.select("fp", F.explode(ball).alias("p"))
        least = points.groupBy("p").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter(F.col("a") < F.col("z"))
        stars = points.join(least.hint("merge"), "p").select("a", F.col("fp").alias("b")).filter((F.col("a") < F.col("b")) & near("a", "b"))
    else:
        # One bit apart: the one with the set bit names the other, so the pairs are linear already.
        other = crowd.select(F.col("fp").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), flip)).alias("b"))
        stars = other.join(crowd.select(F.col("fp").alias("b")).hint("merge"), "b", "left_semi").filter("a < b").select("a", "b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable over the edges (a, b), for each node that has one.

    Large-star and small-star rounds; each is written to the shared folder. The number of rounds grows with the
    logarithm of the longest chain; the loop ends when a round changes nothing. A node that many edges share is met by
    an aggregate and, where its edges are many, by a join that adaptive execution splits."""
    edges = scratch.write(edges.select(F.col("a"), F.col("b")), "edges")
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        two = [F.struct(F.col(x).alias("x"), F.col("m").alias("y")) for x in "ba"]
        small = large.join(small_least, "a").select(F.explode(F.array(*two)).alias("e"))
        small = small.select(F.greatest("e.x", "e.y").alias("b"), F.least("e.x", "e.y").alias("a")).filter("a != b")
        before, edges = edges, scratch.write(small.select("a", "b").distinct(), "edges")
        scratch.drop(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


#: A fingerprint of more than this share of all rows is joined by broadcast: there are at most 1 / HOT of them.
HOT = 1e-3


def classes(prints: DataFrame, linked: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(id, h, fp, root, component_id) for each row of prints (id, h, fp): the least fingerprint and the least id of its component. linked gives the
    links between the distinct fingerprints. The result is written, and outlives the scratch.

    Fingerprints are counted before rows are joined with what is known of them. The few that hold a large share of the rows (a
    bounded number of them) are joined by broadcast, so that no task gets a group of copies as a whole."""
    distinct = scratch.write(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "distinct")
    roots = components(linked(distinct.select("fp")), scratch).withColumnRenamed("node", "fp")
    named = scratch.write(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    # Components of many fingerprints are few, and meet their members by broadcast.
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    best = scratch.write(best, "best")
    large = F.col("size") > HOT * best.count()
    wide = named.join(F.broadcast(best.filter(large).drop("size")), "root")
    few = F.broadcast(best.filter(large).select("root"))
    known = wide.unionByName(named.join(few, "root", "left_anti").join(best.filter(~large).drop("size"), "root"))
    known = scratch.write(known.select("fp", "n", "root", "component_id"), "known")
    hot = F.col("n") > HOT * (distinct.agg(F.sum("n")).first()[0] or 0)
    few = known.filter(hot).select("fp", "root", "component_id")
    rest = known.filter(~hot).select("fp", "root", "component_id")
    common = prints.join(F.broadcast(few), "fp")
    other = prints.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(rest, "fp")
    return materialise(common.unionByName(other).select("id", "h", "fp", "root", "component_id"), "classes")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    with Scratch(docs.sparkSession, "simhash") as scratch:
        prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        return classes(prints, lambda distinct: links(distinct, scratch, distance), scratch)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits) and component_id (least id reachable over links).

    Null or blank texts have fingerprint zero and are linked like any other. Rows with a null id take part; a component
    of such rows alone has a null component_id. Repeated rows are kept. A text of any length is hashed
    whole, in one task. An empty table gives an empty result. Other columns of docs are not looked at, whatever their names."""
    rows = _classes(docs, id_col, text_col, shingle, distance)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """Of each group of near-duplicates the row with the least id, with all its columns. Rows without an id stay only where no row of
    their group has one; of rows that repeat that id within the group one stays, chosen by a hash of its text."""
    return first_of_each(docs, _classes(docs, id_col, text_col, shingle, distance), id_col, text_col)


#: Rows to leave out are broadcast if they are at most so many, else joined by shuffle.
BROADCAST = 2_000_000


def first_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that keep_one keeps, of the groups in rows (id, h, root)."""
    head = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("e"))
    key = F.xxhash64("id", "h").alias("key")  # nulls leave the hash as it is, which is a key like any other
    kept = head.select(F.col("e.id").alias("id"), F.col("e.h").alias("h")).select(key)
    each = materialise(rows.select(key).groupBy("key").count().join(kept.withColumn("kept", F.lit(True)), "key", "left"), "keys")
    mark = fresh(docs, "row_key")
    other = fresh(docs, mark + "_")
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)))

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("key").alias(other))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST else keys
        return df.join(keys, F.col(mark) == F.col(other), how)

    out = among(docs.withColumn(mark, own), each.filter("kept IS NULL"), "left_anti")
    again = each.filter("kept AND count > 1")
    if again.isEmpty():
        return out.drop(mark)
    # Repeated rows: one of each by an aggregate, which combines them before they are shuffled.
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.hash(*[F.col(c) for c in docs.columns])).alias("row")
    once = among(out, again, "left_semi").groupBy(mark).agg(row).select("row.*")
    return among(out, again, "left_anti").drop(mark).unionByName(once)
