"""Cross-entropy difference of two n-gram models (target and background) over one vocabulary.

The vocabulary is every word of all documents and an end of text; nothing is cut off, so it and the bigrams grow with the
corpus. Both models have the same form: a bigram model smoothed towards single words (Dirichlet),

    p(w | v) = (c(v w) + m p(w)) / (c(v) + m),   p(w) = (c(w) + a) / (N + a V),

and count all documents (background) or those that are marked (target). A token's own occurrence is left out of the
counts that score it (in the background always, in the target where its document is marked), so that documents of
the target are not scored by themselves; what a document repeats is still counted. Each token, and the end of the text, has
a loss under both models, and a document's score is the mean of the differences (target less background): the lower, the
more like the target.

No task needs a whole model. Occurrences are dealt by their word, in packed arrays, over as many parts as the corpus asks for; a
part has all occurrences of its words, so it counts their bigrams and scores them in one go, and gives back sums for the rows of
each chunk of documents. Words of at least `hot` of all tokens (at most 1 / hot of them) would swamp their part: the counts of
these words and of pairs of them are bounded tables, which are broadcast, and what precedes them deals out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, WORD_BYTES, buffers, distinct_spans, fresh, map_texts, materialise, pieces, text_of, word_spans

_TABLE = np.frombuffer(WORD_BYTES, dtype=np.uint8)
#: What stands before the first word and after the last.
START, END = 1, 2
#: Where target's ids are at most so many they are broadcast, else rows and labels are joined by sort and merge.
BROADCAST = 4_000_000
MARK = np.uint16(1 << 15)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a column: first and last row, the 64-bit ids of their words (XXH3 of the bytes), and the rows (from the first)."""
    data, at = buffers(column)
    for first, last in pieces(at):
        part = _TABLE[data[at[first] : at[last]]]
        starts, ends, rows = word_spans(part, at[first : last + 1] - at[first])
        codes, each = distinct_spans(part, starts, ends)
        raw = part.tobytes()
        ids = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts[each].tolist(), ends[each].tolist())]
        yield first, last, np.array(ids, np.uint64)[codes], rows


def _events(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What precedes, what follows, and the row: for each word of the rows, and for the end of each row that has words."""
    first = np.diff(rows, prepend=-1) != 0
    last = np.append(first[1:], True) if len(rows) else first
    slots = np.arange(len(words)) + np.cumsum(first) - 1
    n = len(words) + int(first.sum())
    after, before, owner = np.full(n, END, np.uint64), np.full(n, START, np.uint64), np.zeros(n, np.int64)
    after[slots] = words
    owner[slots] = rows
    owner[slots[last] + 1] = rows[last]
    before[slots + 1] = words
    return before, after, owner


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n, t) from (text, mark): how often each word, and the end of a text, follows anything in all rows and in those marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, code = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = [np.bincount(code, weights=np.concatenate([h[k] for h in held])).astype(np.int64) for k in (1, 2)]
            return w, *sums

        for b in batches:
            marked = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, words, rows in _tokens(b.column(0)):
                _, after, owner = _events(words, rows)
                w, code = np.unique(after, return_inverse=True)
                own = marked[first:last][owner]
                held.append((w, np.bincount(code), np.bincount(code, weights=own)))
                size += len(w)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # what one task holds stays bounded
                        yield _batch(*held[0])
                        held, size = [], 0
        if held:
            yield _batch(*merged())

    def _batch(w: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n), pa.array(t)], names=["w", "n", "t"])

    return map_texts(docs.select("text", "mark"), run, "w long, n long, t long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


@dataclass(frozen=True)
class Model:
    """What every task knows: sums, the hot words (ids in order; START and END are always among them) and the table of
    their pairs; a column of `counts` and an entry of `pairs` is for the background, then for the target."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    total: np.ndarray
    vocabulary: int
    parts: int
    prior: float
    smooth: float

    def hot(self, ids: np.ndarray) -> np.ndarray:
        """The number of each id among the hot words, or -1."""
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at, -1)

    def single(self, count: np.ndarray, less: np.ndarray, k: int) -> np.ndarray:
        return (count - less + self.smooth) / (self.total[k] - less + self.smooth * self.vocabulary)

    def follow(self, pair: np.ndarray, count: np.ndarray, less: np.ndarray, k: int) -> np.ndarray:
        """Losses of words so often seen after what precedes them (`pair`) and at all (`count`), but for the division by what precedes."""
        return -np.log(pair - less + self.prior * self.single(count, less, k))

    def precede(self, count: np.ndarray, less: np.ndarray) -> np.ndarray:
        return np.log(count - less + self.prior)


def pair_counts(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(cell, n, t) from (text, mark): how often a hot word (cell // len(hot)) precedes another (cell % len(hot))."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        known = Model(words, *[np.zeros(0)] * 3, 0, 1, 1.0, 1.0)
        n = np.zeros((2, len(words) ** 2), np.int64)
        for b in batches:
            marked = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, ids, rows in _tokens(b.column(0)):
                before, after, owner = _events(ids, rows)
                x, y = known.hot(before), known.hot(after)
                both = (x >= 0) & (y >= 0)
                cells, own = (x * len(words) + y)[both], marked[first:last][owner[both]]
                for k, c in enumerate((cells, cells[own])):
                    at, m = np.unique(c, return_counts=True)
                    n[k][at] += m
        cells = np.flatnonzero(n[0])
        for i in range(0, len(cells), 100_000):
            c = cells[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n[0][c]), pa.array(n[1][c])], names=["cell", "n", "t"])

    counted = map_texts(docs.select("text", "mark"), run, "cell long, n long, t long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


#: part: where it is dealt to; kind: 0 the rows of a chunk, 1 words after anything, 2 hot words after words that aren't;
#: the rest are packed arrays. Rows are numbers within the chunk, with the top bit for marked ones.
PACKED = "part long, kind int, chunk long, keys binary, lens binary, subs binary, rows binary"
_NAMES = ["part", "kind", "chunk", "keys", "lens", "subs", "rows"]


def _packed(model: Model, rows: DataFrame, most_rows: int, most_events: int) -> DataFrame:
    """PACKED from (id, text, mark): the occurrences of all words, dealt by word, and for each chunk its rows with what tasks can tell themselves."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunk = sent.value, TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        n_rows = n_events = 0
        for b in batches:
            ids, marked = b.column(0), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, words, owner in _tokens(b.column(1)):
                for s in range(first, last, most_rows):
                    e = min(last, s + most_rows)
                    if held and (n_rows + e - s > most_rows or n_events > most_events):
                        yield _chunk(model, chunk, held)
                        chunk, held, n_rows, n_events = chunk + 1, [], 0, 0
                    own = (owner >= s - first) & (owner < e - first) if e - s < last - first else slice(None)
                    held.append((ids.slice(s, e - s), marked[s:e], words[own], owner[own] - (s - first)))
                    n_rows, n_events = n_rows + e - s, n_events + len(held[-1][2])
        if held:
            yield _chunk(model, chunk, held)

    return map_texts(rows.select("id", "text", "mark"), run, PACKED)


def _chunk(model: Model, chunk: int, held: list[tuple]) -> pa.RecordBatch:
    """The rows of PACKED of one chunk."""
    ids = pa.concat_arrays([h[0] for h in held])
    marked = np.concatenate([h[1] for h in held])
    first = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
    before, after, row = _events(np.concatenate([h[2] for h in held]), np.concatenate([h[3] + f for h, f in zip(held, first)]))
    own = marked[row]
    x, y = model.hot(before), model.hot(after)
    sums = np.zeros((2, len(marked)))
    for k, less in enumerate((np.ones(len(row)), own.astype(float))):
        at = np.flatnonzero(x >= 0)
        sums[k] += np.bincount(row[at], model.precede(model.counts[k][x[at]], less[at]), len(marked))
        at = np.flatnonzero((x >= 0) & (y >= 0))
        pairs = model.pairs[k][x[at] * len(model.words) + y[at]]
        sums[k] += np.bincount(row[at], model.follow(pairs, model.counts[k][y[at]], less[at], k), len(marked))
    events = np.bincount(row, minlength=len(marked)).astype(np.int32)
    there = np.asarray(ids.is_valid()).astype(np.uint8)
    numbers = ids.fill_null(0).to_numpy().astype(np.int64)
    out = [(-1 - chunk, 0, chunk, numbers.tobytes(), there.tobytes(), events.tobytes(), sums.tobytes())]
    packed_row = row.astype(np.uint16) | np.where(own, MARK, np.uint16(0))
    for kind, at in ((1, np.flatnonzero(y < 0)), (2, np.flatnonzero((y >= 0) & (x < 0)))):
        key = (after if kind == 1 else before)[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] - np.uint64(1))) if len(key) else np.zeros(0, np.int64)
        keys, lens = key[starts], np.diff(starts, append=len(key)).astype(np.uint32)
        if kind == 1:  # the upper 48 bits tell apart what precedes one word
            subs = np.ascontiguousarray(before[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
        else:
            subs = y[at].astype("<u2")
        part = (keys >> np.uint64(32)) * np.uint64(model.parts) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(part, prepend=part[:1] - np.uint64(1))) if len(part) else []
        for s, e in zip(cuts, [*cuts[1:], len(part)]):
            i, j = starts[s], starts[e] if e < len(starts) else len(key)
            packed = [x.tobytes() for x in (keys[s:e], lens[s:e], subs[i:j], packed_row[at[i:j]])]
            out.append((int(part[s]), kind, chunk, *packed))
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=_NAMES)


SUMS = "chunk long, kind int, rows binary, sums binary, ids binary, there binary"


def _score_part(model: Model, table: pa.Table) -> pa.Table:
    """Of all occurrences of some words the sums of losses for the rows of each chunk; the rows of a chunk (kind 0) are passed on."""
    out: dict[str, list] = {n: [] for n in ("chunk", "kind", "rows", "sums", "ids", "there")}

    def put(*values) -> None:
        for column, v in zip(out.values(), values):
            column.append(v)

    columns = table.to_pydict()
    blobs = list(zip(*[columns[n] for n in _NAMES[1:]]))
    for kind in (1, 2):
        own = [b for b in blobs if b[0] == kind]
        if not own:
            continue
        read = lambda j, t: np.frombuffer(b"".join(b[j] for b in own), t)
        lens, rows = read(3, np.uint32), read(5, np.uint16)
        key = np.repeat(read(2, np.uint64), lens)
        if kind == 1:
            wide = np.zeros((len(rows), 8), np.uint8)
            wide[:, 2:] = read(4, np.uint8).reshape(-1, 6)
            sub = wide.view("<u8").ravel()
        else:
            sub = read(4, "<u2").astype(np.uint64)
        pair = _numbers(key * np.uint64(0x9E3779B97F4A7C15) ^ _spread(sub))
        less = [np.ones(len(rows)), (rows >= MARK).astype(float)]
        n_rows = np.array([len(b[5]) // 2 for b in own])
        place = np.repeat(np.arange(len(own)), n_rows) << 16 | (rows & ~MARK)
        cell, code = np.unique(place, return_inverse=True)
        word = _numbers(key) if kind == 1 else None
        sums = []
        for k in range(2):
            count = np.bincount(word, less[k])[word] if kind == 1 else model.counts[k][sub.astype(np.int64)]
            loss = model.follow(np.bincount(pair, less[k])[pair], count, less[k], k)
            if kind == 1:
                loss = loss + model.precede(count, less[k])
            sums.append(np.bincount(code, loss).astype(np.float32))
        blob = cell >> 16
        cuts = np.searchsorted(blob, np.arange(len(own) + 1))
        for b, s, e in zip(own, cuts, cuts[1:]):
            put(b[1], kind, (cell[s:e] & 0xFFFF).astype(np.uint16).tobytes(), np.stack([x[s:e] for x in sums]).tobytes(), None, None)
    for _, chunk, ids, there, events, base in (b for b in blobs if b[0] == 0):
        put(chunk, 0, events, base, ids, there)
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _numbers(x: np.ndarray) -> np.ndarray:
    import pandas as pd

    return pd.factorize(x)[0]


def _spread(x: np.ndarray) -> np.ndarray:
    h = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _score_chunk(table: pa.Table) -> pa.Table:
    """The rows of a chunk with the sums of all parts."""
    columns = table.to_pydict()
    at = columns["kind"].index(0)
    ids, there = np.frombuffer(columns["ids"][at], np.int64), np.frombuffer(columns["there"][at], np.uint8).astype(bool)
    events = np.frombuffer(columns["rows"][at], np.int32).astype(np.int64)
    total = np.frombuffer(columns["sums"][at]).reshape(2, -1).copy()
    for kind, rows, sums in zip(columns["kind"], columns["rows"], columns["sums"]):
        if kind:
            total[:, np.frombuffer(rows, np.uint16)] += np.frombuffer(sums, np.float32).reshape(2, -1)
    none = events == 0
    per = total / np.maximum(events, 1)
    losses = [pa.array(x, mask=none) for x in (per[1], per[0], per[1] - per[0])]
    own = [pa.array(ids, mask=~there), pa.array(np.maximum(events - 1, 0))]
    return pa.table([*own, *losses], names=["id", "n_tokens", "loss_target", "loss_background", "score"])


def lm_score(
    docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", prior: float = 50.0, smooth: float = 0.1,
    hot: float = 1e-3, part_events: int = 1 << 21, chunk_rows: int = 8192, chunk_events: int = 1 << 20,
) -> DataFrame:
    """Per row of docs: id, n_tokens, loss_target and loss_background (nats a token) and score, their difference.

    target: a boolean column of docs that marks the target's rows (null: not marked). Null and blank texts have no tokens
    and null losses and score. Without any target its model knows only the vocabulary. Repeated rows are kept, and
    counted as often. An empty table gives an empty result. No word is cut off, so ties don't matter; texts of any length are one row.
    Other columns of docs are not looked at, whatever their names.
    prior: m above; smooth: a; part_events: about how many occurrences a part has; chunk_rows (32,768 at most)
    and chunk_events bound what a task holds before it sends it on."""
    if not 0 < chunk_rows <= 1 << 15:
        raise ValueError("chunk_rows is from 1 to 32768")
    spark = docs.sparkSession
    mark = F.coalesce(F.col(target).cast("boolean"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), mark.alias("mark"))
    with Scratch(spark, "words") as scratch:
        counts = scratch.write(word_counts(rows), "counts")
        sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum("t").alias("t")).first()
        total = np.array([float(sums.n or 0), float(sums.t or 0)])
        top = counts.filter(F.col("n") >= max(1.0, hot * total[0])).collect()  # at most 1 / hot
        ends = counts.filter(F.col("w") == END).first()
    known = {np.uint64(r.w & 0xFFFFFFFFFFFFFFFF): (r.n, r.t) for r in top}
    known[np.uint64(END)] = known[np.uint64(START)] = (ends.n, ends.t) if ends else (0, 0)
    words = np.array(sorted(known), np.uint64)
    each = np.array([known[w] for w in words], float).T
    pairs = np.zeros((2, len(words) ** 2))
    for r in pair_counts(rows, words).collect():  # at most the square of that
        pairs[:, r.cell] = r.n, r.t
    parts = max(1, -(-int(total[0]) // part_events))
    model = Model(words, each, pairs, total, max(1, sums.v), parts, prior, smooth)
    sent = spark.sparkContext.broadcast(model)
    packed = _packed(model, rows, chunk_rows, chunk_events)
    scored = packed.groupBy("part").applyInArrow(lambda table: _score_part(sent.value, table), SUMS)
    schema = "id long, n_tokens long, loss_target double, loss_background double, score double"
    return scored.groupBy("chunk").applyInArrow(_score_chunk, schema).withColumnRenamed("id", id_col)


def mark_target(docs: DataFrame, labels: DataFrame, mark: str, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """docs with a column `mark`: whether the row's id is labelled 1. The ids are broadcast where they are at most BROADCAST; else
    rows and labels meet by sort and merge, rows without an id apart, and the result is written, so that later passes see the rows in
    one order."""
    good = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull())
    key = fresh(docs, "target_id")
    good = good.select(F.col(id_col).cast("long").alias(key)).distinct()
    same = docs[id_col].cast("long") == good[key]
    if good.count() <= BROADCAST:
        return docs.join(F.broadcast(good), same, "left").withColumn(mark, F.col(key).isNotNull()).drop(key)
    out = docs.filter(F.col(id_col).isNotNull()).join(good.hint("merge"), same, "left").withColumn(mark, F.col(key).isNotNull()).drop(key)
    return materialise(out.unionByName(docs.filter(F.col(id_col).isNull()).withColumn(mark, F.lit(False))), "marked")
