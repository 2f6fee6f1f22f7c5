"""Benchmark decontamination: an exact prefix-filtered join of benchmark windows with documents.

Every run of `window` consecutive words of an item is a window (a shorter item is one window). A document contains a
window only if it has all its words in a row, so one necessary word is prefix enough: the one that is rarest in the
documents. Documents are joined with the windows on that word; the place of the word in the window gives where the
window would have to lie, which must be within the document (the bounds on length and position), and there all words
are compared.

The windows are sent to the tasks in groups of `max_windows` at most, so that what is broadcast stays bounded however
large the benchmark is; beyond one group the documents are read once for each group, and their hits are put together.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, buffers, map_texts, text_of

SPANS = "id long, h long, n_words long, spans array<long>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, items): each distinct window, its words joined by spaces, with the ids (as text) of the items that hold it.
    Items without words have none; the windows of items without an id are windows of no id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            raw, at, ids = data.tobytes(), at.tolist(), b.column(0).to_pylist()
            items, wins = [], []
            for i, item in enumerate(ids):
                words = words_of(raw[at[i] : at[i + 1]])
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    wins.append(b" ".join(words[k : k + window]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wins, pa.string())], names=["item", "win"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).alias("t"))
    return map_texts(rows, run, "item string, win string").groupBy("win").agg(F.collect_set("item").alias("items"))


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value, Counter()
        for b in batches:
            data, at = buffers(b.column(0))
            raw, at = data.tobytes(), at.tolist()
            for i in range(b.num_rows):
                counts.update(known.intersection(words_of(raw[at[i] : at[i + 1]])))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    rows = map_texts(docs.select(text_of(text_col).alias("t")), run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r.w.encode(): r.n for r in rows}


def window_index(docs: DataFrame, wins: list[tuple[str, list[str]]], text_col: str) -> dict[bytes, list]:
    """For the word of each window that is in the fewest documents: the windows (words, place of the word, items)."""
    split = [(tuple(w.encode().split(b" ")), items) for w, items in wins]
    often = document_frequency(docs, {x for w, _ in split for x in w}, text_col)
    index: dict[bytes, list] = defaultdict(list)
    for w, items in split:
        rare = min(w, key=lambda x: (often.get(x, 0), x))
        index[rare].append((list(w), w.index(rare), items))
    return dict(index)


def occurrences(index: dict[bytes, list], words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, items) of all windows that occur in the words of a text."""
    n = len(words)
    for p, x in enumerate(words):
        if x in index:
            for win, offset, ids in index[x]:
                s = p - offset
                if s >= 0 and s + len(win) <= n and words[s : s + len(win)] == win:
                    yield s, s + len(win), ids


def _join_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans (start, end, start, end, ...) that cover the same."""
    merged: list[int] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1]:
            merged[-1] = max(merged[-1], e)
        else:
            merged += [s, e]
    return merged


def _scan(docs: DataFrame, wins: list[tuple[str, list[str]]], id_col: str, text_col: str) -> DataFrame:
    """SPANS for each row: the words hit by these windows, as sorted disjoint spans (start, end, start, end, ...)."""
    sent = docs.sparkSession.sparkContext.broadcast(window_index(docs, wins, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            data, at = buffers(b.column(2))
            raw, at = data.tobytes(), at.tolist()
            counts, spans, found = [], [], []
            for i in range(b.num_rows):
                words = words_of(raw[at[i] : at[i + 1]])
                hits = list(occurrences(index, words))
                counts.append(len(words))
                spans.append(_join_spans([h[:2] for h in hits]))
                found.append(sorted({x for h in hits for x in h[2]}))
            lists = [pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            own = [b.column(0), b.column(1), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *lists], names=["id", "h", "n_words", "spans", "items"])

    text = text_of(text_col)
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")), run, SPANS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the spans and items of several scans of a row together."""
    for b in batches:
        spans = [_join_spans([(x[k], x[k + 1]) for x in lists for k in range(0, len(x), 2)]) for lists in b.column(3).to_pylist()]
        items = [sorted({y for x in lists for y in x}) for lists in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["id", "h", "n_words", "spans", "items"])


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", max_windows: int = 200_000) -> DataFrame:
    """id, hash of the text, words, the spans of words that lie in an occurrence of a benchmark window, and the items found.

    One row per row of docs. Null and blank texts have no words. Repeated rows are kept. An empty table or benchmark
    gives no hits. Columns of docs other than the id and the text are not looked at."""
    wins = benchmark_windows(benchmark, window)
    groups = max(1, -(-wins.count() // max_windows))
    if groups == 1:
        return _scan(docs, [(r.win, r["items"]) for r in wins.collect()], id_col, text_col)
    scans = []
    for k in range(groups):
        some = wins.filter(F.pmod(F.xxhash64("win"), F.lit(groups)) == k).collect()
        scan = _scan(docs, [(r.win, r["items"]) for r in some], id_col, text_col)
        scans.append(scan.withColumn("k", F.lit(k)))
    rows = scans[0]
    for scan in scans[1:]:
        rows = rows.union(scan)
    # Rows that are the same have the same hits, so they are counted, and given out as often again.
    each = rows.groupBy("id", "h", "n_words").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"), F.count_if(F.col("k") == 0).alias("times"))
    whole = each.select("id", "h", "n_words", "spans", "items").mapInArrow(_merge, SPANS)
    times = each.select("id", "h", "n_words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    keys = [whole[c].eqNullSafe(times[c]) for c in ("id", "h", "n_words")]
    return whole.join(times, keys[0] & keys[1] & keys[2]).select(whole["*"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", max_windows: int = 200_000) -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, items_sha256 and contaminated, as hit_spans finds them.

    Null and blank texts have no words and no hits; a text of any length is read whole, in one task. Rows that repeat are each returned; of items that
    repeat an id with other texts all windows are that id's, and windows of items without an id are hits that belong to no id. An empty table, or
    benchmark, gives an empty result, or no hits. Other columns are not looked at, whatever their names."""
    rows = hit_spans(docs, benchmark, window, id_col, text_col, max_windows)
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.when(a["s"] < 0, F.struct(a["n"].alias("n"), x.alias("s"))).otherwise(F.struct((a["n"] + x - a["s"]).alias("n"), F.lit(-1).cast("long").alias("s"))))["n"]
    return rows.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean_only(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    max_windows: int = 200_000,
) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window. The rows pass through the tasks that scan them,
    once for each group of windows, so that nothing is joined or shuffled. Rows with null, blank or very long texts, repeated rows and rows without an
    id are judged like any other; columns keep their names, whatever they are. An empty table gives an empty result."""
    wins = benchmark_windows(benchmark, window)
    groups = max(1, -(-wins.count() // max_windows))
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    out = docs
    for k in range(groups):
        some = wins.filter(F.pmod(F.xxhash64("win"), F.lit(groups)) == k).collect()
        index = window_index(docs, [(r.win, r["items"]) for r in some], text_col)
        out = map_texts(out, _cleaner(docs.sparkSession.sparkContext.broadcast(index), place), docs.schema)
    return out


def _cleaner(sent, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            column = b.column(place)
            data, at = buffers(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast("string"))
            raw, at = data.tobytes(), at.tolist()
            clean = [next(occurrences(index, words_of(raw[s:e])), None) is None for s, e in zip(at, at[1:])]
            yield b.filter(pa.array(clean, pa.bool_()))

    return run
