"""Licence scans: the Dice coefficient over word bigrams between windows of a text and licence templates.

A text is normalised to words of letters and digits in lower case; line breaks and punctuation play no part. A window is any run
of its words, the whole text among them. Of a template with b bigrams and a window with m, which share s (as multisets), the
coefficient is 2 s / (b + m); it can reach the threshold t only if m is within b t / (2 - t) and b (2 - t) / t, and then s is at
least b t / (2 - t). So a template is tried only where that many of its bigrams lie within its longest window, which
counts of touched places tell for all templates and texts of a batch at once.

Of the windows that are left, only those that begin and end with a bigram of the template can be the best: without a foreign
bigram at an end the coefficient is higher. From each such beginning the windows grow bigram by bigram, and what they share
with the template is a running sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, buffers, distinct_spans, map_texts, pieces, text_of, word_spans
from tidemark.llm.license_texts import TEMPLATES

_TABLE = np.frombuffer(WORD_BYTES, dtype=np.uint8)


class Library:
    """Templates (licence, kind, text) by bigram, with their sizes. Templates of fewer than two words have no bigrams and match nothing."""

    def __init__(self, templates: list[tuple[str, str, str]], threshold: float):
        self.templates, self.threshold = templates, threshold
        texts = [text.encode().translate(WORD_BYTES).split() for _, _, text in templates]
        self.words: dict[bytes, int] = {}
        for words in texts:
            for w in words:
                self.words.setdefault(w, len(self.words))
        counts = [Counter(self.words[a] * len(self.words) + self.words[b] for a, b in zip(t, t[1:])) for t in texts]
        self.codes = np.array(sorted({x for c in counts for x in c}), np.int64)
        self.sizes = [c.total() for c in counts]
        #: how often each bigram (column) occurs in each template (row)
        self.counts = np.zeros((len(templates), len(self.codes)), np.int64)
        for k, c in enumerate(counts):
            self.counts[k, np.searchsorted(self.codes, list(c))] = list(c.values())
        t = threshold
        self.longest = [int(b * (2 - t) / t + 1e-9) for b in self.sizes]
        self.needed = [max(1, int(np.ceil(b * t / (2 - t) - 1e-9))) for b in self.sizes]

    def touched(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the texts of a piece: places of bigrams of any template (the number of their first word in the text), which bigrams, and the rows."""
        part = _TABLE[data]
        starts, ends, rows = word_spans(part, at)
        codes, first = distinct_spans(part, starts, ends)
        raw = part.tobytes()
        known = [self.words.get(raw[s:e], -1) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        word = np.array(known, np.int64)[codes]
        a, b = word[:-1], word[1:]
        pair = np.flatnonzero((a >= 0) & (b >= 0) & (rows[:-1] == rows[1:]))
        code = a[pair] * len(self.words) + b[pair]
        gram = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[gram] == code if len(self.codes) else np.zeros(len(code), bool)
        pair, gram = pair[hit], gram[hit]
        begin = np.searchsorted(rows, rows[pair], "left")
        return pair - begin, gram, rows[pair]

    def scan(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, template, coefficient, first word, last word) of the best window for each template that reaches the threshold in
        a text; of equal ones the first, then the shortest."""
        place, gram, row = self.touched(data, at)
        gap = 2 + max(self.longest, default=0)
        apart = place + row * (gap + int(place.max(initial=0)))  # so that no window holds places of two texts
        for k, (longest, needed) in enumerate(zip(self.longest, self.needed)):
            if not self.sizes[k]:
                continue
            own = np.flatnonzero(self.counts[k, gram])
            where = apart[own]
            ends = np.searchsorted(where, where + longest)
            begins = np.flatnonzero(ends - np.arange(len(where)) >= needed)
            if not len(begins):
                continue
            owner = row[own]
            for r, some in _groups(owner[begins], begins):
                best = self._best(k, gram[own], where, ends, some)
                if best[0] >= self.threshold:
                    first = place[own[best[1]]]
                    yield r, k, best[0], int(first), int(first + best[2])

    def _best(self, k: int, gram: np.ndarray, where: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[float, int, int]:
        """The best coefficient of windows from these beginnings, where it begins, and its bigrams."""
        lo, hi = int(begins[0]), int(ends[begins].max())
        grams, room = gram[lo:hi], self.counts[k]
        order = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.diff(grams[order], prepend=-1))
        rank = np.empty(len(grams), np.int64)  # how many of the same bigram came before
        rank[order] = np.arange(len(grams)) - np.repeat(first, np.diff(first, append=len(grams)))
        before = np.zeros(len(room), np.int64)
        best, done = (0.0, lo, 0), lo
        for s in begins.tolist():
            np.add.at(before, gram[done:s], 1)
            done = s
            own = slice(s - lo, int(ends[s]) - lo)
            g = grams[own]
            shared = np.cumsum(rank[own] - before[g] < room[g])
            size = where[s : int(ends[s])] - where[s] + 1
            value = 2 * shared / (self.sizes[k] + size)
            i = int(np.argmax(value))
            if value[i] > best[0]:
                best = (float(value[i]), s, int(size[i]))
        return best


def _groups(rows: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(rows, prepend=-1))
    for s, e in zip(cuts, [*cuts[1:], len(rows)]):
        yield int(rows[s]), values[s:e]


_FOUND = "array<struct<license string, kind string, dice double, first_word long, last_word long>>"


def license_spans(
    docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id and found: for each row of docs the licences that reach the threshold, an array of structs (license, kind, dice, first_word,
    last_word: numbers of words from 0), best first, of equal ones by name; of several templates of a licence the best, of equal ones the
    first in order; of equal windows the first, then the shortest.

    Null and blank texts have none; a text of any length is scanned as a whole. Repeated rows are kept. An empty table gives an
    empty result. Other columns aren't looked at. templates: (licence, kind, text), as rows of a table collected by the caller;
    they are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((templates, threshold))
    fields = [("license", pa.string()), ("kind", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(*sent.value)
        for b in batches:
            data, at = buffers(b.column(1))
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for s, e in pieces(at):
                best: dict[int, dict[str, tuple]] = {}
                for row, k, value, first, last in library.scan(data[at[s] : at[e]], at[s : e + 1] - at[s]):
                    name, sort, _ = library.templates[k]
                    mine = best.setdefault(s + row, {})
                    if name not in mine or value > mine[name][0]:
                        mine[name] = (value, sort, first, last)
                for row, mine in best.items():
                    ordered = sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))
                    out[row] = [{"license": n, "kind": c, "dice": v, "first_word": i, "last_word": j} for n, (v, c, i, j) in ordered]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return map_texts(rows, run, f"id long, found {_FOUND}").withColumnRenamed("id", id_col)


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of docs: id, license (the best, else null), dice (else 0), n_licenses and licenses (names, best first, comma-joined)."""
    rows = license_spans(docs, templates, threshold, id_col, text_col)
    best = F.get("found", F.lit(0))
    return rows.select(
        id_col,
        best["license"].alias("license"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("dice"),
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"),
    )
