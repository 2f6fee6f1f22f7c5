"""Near copies by the exact Jaccard similarity (at least 4/5) of their sets of word shingles.

Elements are told apart by 64-bit hashes: XXH64 of each word's bytes, combined over the words of a shingle.

Two sets of sizes n and m with a similarity of at least 4/5 share at least 4/5 of the elements of each; so whatever
order all elements are put in, they have one in common among the first n - ceil(4n/5) + 1 of the one and of the other
(prefix filter). Any order loses nothing; a good one puts common elements last. Here elements go by their hashes, but
those that more than `bucket` sets hold come after all others: a first count over the sets' first elements finds the
sets that have such an element there, and a second over all elements of those sets finds all that are common in them.

Sets that share a first element are candidates. First each set is compared with the least of those that share the element,
which is linear. Where all are linked by now, nothing is to be done: more pairs of a component can only repeat it.
Elsewhere those of different components are candidates: where at most `bucket` sets share the element, pair by pair. Of these,
each component has one tested at a time, the likeliest first, since one link makes many others idle; at the end all that
are left are. Where more share it (large groups of near copies), the sets outside the largest component meet all others, in blocks,
and a task gives the likeliest of each set alone. They are tested, what they link is one component, and the sets that still have others
open give the next ones, eight times as many each time, until nothing is open. So no link between different
components is lost, and what leaves the tasks and is compared as a whole follows the sets, not their pairs.

Before whole sets are compared, candidates are tested by their marks: as many bits as a power of two holds the set's elements
(1,024 at least), each the parity of the elements that fall on it; of two lengths the longer is folded. Marks differ in at
most as many bits as the sets differ in elements, and sets with that similarity differ in at most a ninth of n + m; so the
test loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import Scratch, buffers, map_texts, materialise, pieces, text_of, word_hashes, word_spans

#: 64-bit words of the marks of a set at least.
WORDS = 16
#: A table of numbers is broadcast if it has at most so many rows, else joined by shuffle.
BROADCAST = 100_000
_TABLE = np.frombuffer(simhash.LOWER, dtype=np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a piece the distinct hashes of their shingles, in order within each row, and the offsets of the
    rows. A row with fewer words than a shingle is one shingle; a row without words has none."""
    starts, ends, rows = word_spans(data, at)
    n_rows, n = len(at) - 1, len(starts)
    h = word_hashes(data, starts, ends)
    factor = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(shingle + 1)], dtype=np.uint64)
    per = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(per) - per
    total, owner = np.zeros(max(0, n - shingle + 1), np.uint64), rows[: max(0, n - shingle + 1)]
    for j in range(shingle):
        total += h[j : j + len(total)] * factor[j]
    whole = owner == rows[shingle - 1 :][: len(total)]
    total, owner = total[whole], owner[whole]
    short = np.flatnonzero((per > 0) & (per < shingle))
    few = np.zeros(len(short), np.uint64)
    for j in range(shingle - 1):
        has = per[short] > j
        few[has] += h[first[short[has]] + j] * factor[j]
    few += per[short].astype(np.uint64) * factor[shingle]
    total, owner = _mix(np.concatenate([total, few])), np.concatenate([owner, short])
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[new], owner[new]
    return total, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))])


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, h, fp, n, marks, first): for each row a hash of its text, one of its set, the set's size, marks and first elements,
    in order of the hashes. A task gives the last three of equal sets once, and null after that. Texts without words have fp zero,
    and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, keys, new, items, ends in _batches(batches, shingle):
            rows, sizes = len(new), np.diff(ends)
            words = np.where(new, np.maximum(WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 64)).astype(np.int64).clip(0)), 0)
            held = items[np.repeat(new, sizes)]
            owner = np.repeat(np.arange(rows), np.where(new, sizes, 0))
            word = (held >> np.uint64(6)).astype(np.int64) & (words[owner] - 1)
            marks = np.zeros(words.sum(), np.uint64)
            np.bitwise_xor.at(marks, (np.cumsum(words) - words)[owner] + word, np.uint64(1) << (held & np.uint64(63)))
            marks = marks.view(np.int64)
            most = sizes - -(-4 * sizes // 5) + 1
            place = np.arange(len(items)) - np.repeat(ends[:-1], sizes)
            first = items[np.repeat(new, sizes) & (place < np.repeat(most, sizes))].view(np.int64)
            columns = [pa.array(sizes, mask=~new), _lists(marks, words, new), _lists(first, new * most, new)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys), *columns], names=["id", "h", "fp", "n", "marks", "first"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return map_texts(rows, run, "id long, h long, fp long, n long, marks array<long>, first array<long>")


def _batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    """For pieces of batches (id, h, text): ids and hashes, hashes of the sets, whether a set is new in this task, the elements and the rows' offsets in them."""
    seen: set[int] = set()
    for b in batches:
        data, at = buffers(b.column(2))
        for s, e in pieces(at):
            items, ends = _sets(_TABLE[data[at[s] : at[e]]], at[s : e + 1] - at[s], shingle)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(items + np.uint64(1)), dtype=np.uint64)])
            keys = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
            new = np.zeros(e - s, dtype=bool)
            for i, k in enumerate(keys.tolist()):
                if k not in seen and ends[i + 1] > ends[i]:
                    seen.add(k)
                    new[i] = True
            yield [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s)], keys, new, items, ends


def _lists(flat: np.ndarray, sizes: np.ndarray, there: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(~there))


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, items): the whole sets of the rows whose key (a hash of id and text) is in wanted; a set may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, new, items, ends in _batches(batches, shingle):
            sizes = np.diff(ends)
            flat = items[np.repeat(new, sizes)].view(np.int64)
            lists = _lists(flat, new * sizes, new)
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["fp", "items"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    rows = rows.join(_small(wanted), F.xxhash64("id", "h") == wanted["key"], "left_semi")
    return map_texts(rows, run, "fp long, items array<long>").filter("items IS NOT NULL")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small enough; its rows are a few numbers each."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _first(items, n):
    """The elements that the prefix filter needs of n in order."""
    return F.slice(items, F.lit(1), n - F.ceil(n * 4 / F.lit(5)).cast("int") + 1)


def first_items(sets: DataFrame, whole, scratch: Scratch, bucket: int = 32) -> DataFrame:
    """(fp, first): for each set (fp, key, first) the first of its elements in the order of the hashes, common ones last.
    whole gives the whole sets of keys. Common elements are looked for in the sets that have one among a quarter of the
    hashes; an element that isn't found to be common is only more work later."""
    points = sets.select("fp", "key", F.explode("first").alias("p"))
    quarter = points.filter(F.col("p").bitwiseAND(F.lit(3)) == 0)
    crowded = quarter.groupBy("p").count().filter(F.col("count") > bucket).select("p")
    crowded = scratch.write(crowded, "crowded")
    touched = scratch.write(quarter.join(_small(crowded), "p", "left_semi").select("fp", "key").distinct(), "touched")
    held = scratch.write(whole(touched.select("key")), "held")
    inner = F.slice("items", F.lit(1), F.ceil(F.size("items") * 0.6).cast("int"))  # the rest is out of reach for most sets
    points = held.select("fp", F.explode(inner).alias("p"))
    common = scratch.write(points.groupBy("p").count().filter(F.col("count") > bucket).select("p"), "common")
    late = points.join(_small(common), "p", "left_semi").groupBy("fp").agg(F.collect_set("p").alias("late"))
    ordered = F.concat(F.array_except("items", "late"), F.array_sort("late"))
    moved = held.join(late, "fp").select("fp", _first(ordered, F.size("items")).alias("first")).dropDuplicates(["fp"])
    moved = scratch.write(moved, "moved")
    scratch.drop(held)
    rest = sets.join(_small(moved.select("fp")), "fp", "left_anti").select("fp", "first")
    return moved.unionByName(rest)


def _close(n, m):
    """Whether sets of n and m elements can have the similarity."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _both(pairs: DataFrame, named: DataFrame, names: list[str]) -> DataFrame:
    """pairs with columns of named (fp, ...) for a, under their names and _a, and for b, under their names and _b. What many pairs have as b
    makes a skewed join, which adaptive execution splits."""
    one, other = (named.select(F.col("fp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    return pairs.join(one, "a").join(other, "b")


def _folded(marks, words):
    """Marks (a column) as so many words: marks of twice as many are folded once."""
    half = F.size(marks) / 2
    low, high = F.slice(marks, F.lit(1), half.cast("int")), F.slice(marks, (half + 1).cast("int"), half.cast("int"))
    return F.when(F.size(marks) <= words, F.col(marks)).otherwise(F.zip_with(low, high, lambda x, y: x.bitwiseXOR(y)))


def _near(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b, gap) of pairs (a, b) whose sizes and marks leave a link open; gap: differing marks an element. marked has (fp, n, marks)."""
    # Sizes that are close have marks of one length, or one twice the other's.
    rows = _both(pairs, marked, ["n", "marks"]).filter(_close(F.col("n_a"), F.col("n_b")))
    words = F.least(F.size("marks_a"), F.size("marks_b"))
    differ = F.zip_with(_folded("marks_a", words), _folded("marks_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(differ, F.lit(0), lambda t, x: t + x)
    rows = rows.withColumn("gap", differ / (F.col("n_a") + F.col("n_b")))
    return rows.filter(9 * F.col("gap") <= 1).select("a", "b", "gap")


def _similar(pairs: DataFrame, marked: DataFrame, whole, scratch: Scratch) -> DataFrame:
    """(a, b) with a < b: those of pairs (a, b) whose whole sets have the similarity; marked has (fp, key)."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    needed = marked.join(needed, "fp", "left_semi").select("key")
    named = scratch.write(whole(needed), "named")
    same = F.size(F.array_intersect("items_a", "items_b"))
    linked = _both(pairs, named, ["items"]).filter(9 * same >= 4 * (F.size("items_a") + F.size("items_b")))
    linked = scratch.write(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "linked")
    scratch.drop(named)
    return linked


def _connect(near: DataFrame, found: DataFrame, marked: DataFrame, whole, scratch: Scratch, rounds: int = 12) -> DataFrame:
    """found and as many links of near (a, b, gap) as connect what any of them do. In each round every component has one of its pairs with others tested,
    that with the nearest marks, so that components that belong together at least halve; when a round finds nothing more, or after
    `rounds`, all pairs of different components that are left are tested."""
    for k in range(rounds + 1):
        roots = _small(scratch.write(simhash.components(found, scratch), "roots"))
        ends = near
        for x in "ab":
            named = roots.select(F.col("node").alias(x), F.col("root").alias("r" + x))
            ends = ends.join(named, x, "left").withColumn("r" + x, F.coalesce("r" + x, x))
        near = scratch.write(ends.filter("ra != rb").select("a", "b", "gap", "ra", "rb"), "near")
        if near.isEmpty():
            return found
        each = near.select(F.explode(F.array("ra", "rb")).alias("r"), F.struct("gap", "a", "b").alias("x"))
        best = each.groupBy("r").agg(F.min("x").alias("x")).select("x.a", "x.b").distinct()
        best = scratch.write(best if k < rounds else near.select("a", "b"), "best")
        linked = _similar(best, marked, whole, scratch)
        if k == rounds:
            return found.union(linked)
        if linked.isEmpty():
            rest = near.join(best, ["a", "b"], "left_anti").select("a", "b")
            return found.union(_similar(scratch.write(rest, "others"), marked, whole, scratch))
        found = scratch.write(found.union(linked), "found")
        near = near.join(best, ["a", "b"], "left_anti").select("a", "b", "gap")
    return found


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows (p, fp, ...) with the number of blocks of at most about `most` rows that those of p are dealt over, and the block of each."""
    n = rows.groupBy("p").agg(F.ceil(F.count("*") / most).cast("int").alias("n_" + name))
    return rows.join(_small(n), "p").withColumn(name, F.pmod(F.xxhash64("fp"), F.col("n_" + name)).cast("int"))


def _fold(marks: np.ndarray, words: int) -> np.ndarray:
    """Marks (last axis) folded until they are so many words, or as they are if they are no more."""
    while marks.shape[-1] > words:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def _compare(left: pd.DataFrame, right: pd.DataFrame, most: int) -> pd.DataFrame:
    """Pairs of a block of sets left over and a block of the sets that share an element, in different components, that marks and sizes leave: of each set the `most`
    with the nearest marks, after those that it has had (gap and set: seen_gap, seen_b)."""
    found = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "gap": np.zeros(0)})]
    if len(left) and len(right):
        marks = [np.asarray(v, np.int64).view(np.uint64) for v in left["marks"]]
        width = np.array([len(v) for v in right["marks"]])
        tables = {w: np.stack(right["marks"].to_numpy()[width == w]).astype(np.int64).view(np.uint64) for w in np.unique(width).tolist()}
        place = np.zeros(len(right), np.int64)
        for w in tables:
            place[width == w] = np.arange((width == w).sum())
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        fp, roots = right["fp"].to_numpy(), right["root"].to_numpy()
        over = right["left_over"].to_numpy(bool)
        own = zip(*(left[c].to_numpy() for c in ("fp", "root", "seen_gap", "seen_b")))
        for i, (a, root, seen_gap, seen_b) in enumerate(own):
            ok = (roots != root) & (5 * np.minimum(n[i], m) >= 4 * np.maximum(n[i], m))
            ok &= ~over | (fp < a)  # of two sets left over, one is enough to see the pair
            at = np.flatnonzero(ok)
            gap = np.zeros(len(at))
            for w in np.unique(width[at]).tolist():
                part = width[at] == w
                x, y = _fold(marks[i], w), _fold(tables[w][place[at[part]]], len(marks[i]))
                gap[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            gap /= n[i] + m[at]
            new = (9 * gap <= 1) & ((gap > seen_gap) | ((gap == seen_gap) & (fp[at] > seen_b)))
            at, gap = at[new], gap[new]
            order = np.lexsort((fp[at], gap))[:most]
            found.append(pd.DataFrame({"a": np.full(len(order), a), "b": fp[at[order]], "gap": gap[order]}))
    return pd.concat(found, ignore_index=True)


def _parted(entries: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries (p, fp, ...) with the component of each set, of those elements whose sets the links found so far don't bring together."""
    roots = scratch.write(simhash.components(found, scratch), "roots").withColumnRenamed("node", "fp")
    named = entries.join(_small(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.write(named, "named")
    parts = named.groupBy("p").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("p")
    return scratch.write(named.join(_small(scratch.write(parts, "parts")), "p", "left_semi"), "open")


def _few(open_: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b, gap): candidates (_near) of elements that few sets share, entries (p, fp, lo, root): all pairs of different components; all have been compared with the least."""
    few = open_.filter(F.col("fp") != F.col("lo"))
    few = few.groupBy("p").agg(F.collect_list(F.struct("fp", "root")).alias("all"))
    few = few.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    few = few.filter("x.fp < y.fp AND x.root != y.root").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return _near(few.distinct(), marked)


def _crowds(crowd: DataFrame, found: DataFrame, marked: DataFrame, whole, scratch: Scratch, block: int = 4096) -> DataFrame:
    """found and the links among sets that share a crowded element, entries (p, fp), that connect what any do: see the module.

    Which sets are left over, and so see the others, is settled once: of two sets in different components at least one was outside the largest from the
    start. So what a set has yet to see only shrinks, and it has had all others once it is given fewer than it may have."""
    crowd = _parted(crowd.select("p", "fp"), found, scratch)
    sizes = crowd.groupBy("p", "root").count()
    main = scratch.write(sizes.groupBy("p").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
    crowd = scratch.write(crowd.join(_small(main), "p").select("p", "fp", "root", (F.col("root") != F.col("main")).alias("left_over")), "crowd")
    most, seen = 1, None
    while not crowd.isEmpty():
        rows = scratch.write(crowd.join(marked.select("fp", "n", "marks"), "fp").select(*crowd.columns, "n", "marks"), "crowd")
        left = rows.filter("left_over")
        if seen is None:
            left = left.withColumns({"seen_gap": F.lit(-1.0), "seen_b": F.lit(0).cast("long")})
        else:
            had = seen.withColumnRenamed("a", "fp")
            left = left.join(_small(had), "fp", "left").filter("NOT coalesce(done, false)")
            left = left.withColumns({"seen_gap": F.coalesce("seen_gap", F.lit(-1.0)), "seen_b": F.coalesce("seen_b", F.lit(0).cast("long"))})
        left, right = _blocks(scratch.write(left.select(*rows.columns, "seen_gap", "seen_b"), "left"), block, "i"), _blocks(rows, block, "j")
        per_i, per_j = left.select("p", "n_i").distinct(), right.select("p", "n_j").distinct()
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = left.join(_small(per_j), "p").select("p", "i", upto("n_j").alias("j"), "fp", "root", "n", "marks", "seen_gap", "seen_b")
        right = right.join(_small(per_i), "p").select("p", upto("n_i").alias("i"), "j", "fp", "root", "left_over", "n", "marks")
        keys, here = ["p", "i", "j"], most
        compare = lambda x, y: _compare(x, y, here)
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long, gap double")
        place = F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))
        pairs = scratch.write(pairs.distinct().withColumn("r", place).filter(F.col("r") <= most).select("a", "b", "gap"), "pairs")
        if pairs.isEmpty():
            return found
        last = F.max(F.struct("gap", "b")).alias("x")
        told = pairs.groupBy("a").agg(last, (F.count("*") < most).alias("done")).select("a", F.col("x.gap").alias("seen_gap"), F.col("x.b").alias("seen_b"), "done")
        # A set that had others before and gives none now has had them all.
        if seen is not None:
            told = told.unionByName(seen.join(told.select("a"), "a", "left_anti").withColumn("done", F.lit(True)))
        seen = scratch.write(told, "seen")
        linked = _similar(pairs.select("a", "b"), marked, whole, scratch)
        found = scratch.write(found.union(linked).distinct(), "found")
        crowd = _parted(crowd.select("p", "fp", "left_over"), found, scratch)
        most *= 8
    return found


def links(sets: DataFrame, whole, scratch: Scratch, bucket: int = 32) -> DataFrame:
    """(a, b) with a < b for distinct sets (fp, key, n, marks, first): links with a Jaccard similarity of at least 4/5, so many that
    all sets that any such links connect are connected. whole gives the whole sets (fp, items) of keys."""
    marked = scratch.write(sets.select("fp", "key", "n", "marks"), "marked")
    entries = first_items(sets, whole, scratch, bucket).select("fp", F.explode("first").alias("p")).repartition("p")
    counts = entries.groupBy("p").agg(F.count("*").alias("k"), F.min("fp").alias("lo")).filter("k > 1")
    met = scratch.write(entries.join(counts.hint("merge"), "p"), "met")
    stars = met.filter("fp != lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()
    stars = scratch.write(_near(stars, marked).select("a", "b"), "close")
    found = _similar(stars, marked, whole, scratch)
    open_ = _parted(met, found, scratch)
    found = _connect(scratch.write(_few(open_.filter(F.col("k") <= bucket), marked), "few"), found, marked, whole, scratch)
    return _crowds(open_.filter(F.col("k") > bucket), found, marked, whole, scratch)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bucket: int = 32) -> DataFrame:
    """Of each group of rows linked by similar shingle sets the row with the least id, as simhash.keep_one does. Blank
    texts are one group. Rows without an id stay only where no row of their group has one. Repeated rows are one group,
    of which one stays. An empty table gives an empty result; other columns are kept, whatever their names."""
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        rows = scratch.write(shingle_sets(docs, id_col, text_col, shingle), "shingles")
        key = F.min(F.xxhash64("id", "h")).alias("key")
        sets = rows.filter("n IS NOT NULL").groupBy("fp").agg(key, *[F.first(c).alias(c) for c in ("n", "marks", "first")])
        sets = scratch.write(sets, "sets")
        narrow = scratch.write(rows.select("id", "h", "fp"), "rows")
        scratch.drop(rows)
        whole = lambda keys: whole_sets(docs, keys, id_col, text_col, shingle)
        found = scratch.write(links(sets, whole, scratch, bucket), "links")
        known = simhash.classes(narrow, lambda distinct: found, scratch)
        return simhash.first_of_each(docs, known, id_col, text_col)
