"""Statistics of whole texts, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import buffers, distinct_spans, map_texts, pieces, word_spans

#: Bytes that make up mostly decoration, in ASCII.
SYMBOLS = b"!$%&*#|=<>{}[]~^_\\+@"
#: Function words of the four languages that are most common on the web in Latin script here: fixed values.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "be", "at", "this",
    "from", "or", "by",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "est", "pour", "par", "au",
    "der", "die", "das", "und", "ist", "ein", "eine", "den", "dem", "zu", "mit", "von", "auf", "nicht",
    "el", "los", "las", "y", "del", "se", "con", "su", "al", "es", "no", "una", "para",
]

NAMES = [
    "n_chars", "n_words", "mean_word", "symbol_rate", "capital_rate", "digit_rate", "distinct_words", "stop_rate",
    "line_rate", "distinct_lines", "stop_marks", "last_mark",
]

_BLANKS = b" \t\n\v\f\r"
_TO_BLANK = np.array([32 if b in _BLANKS else b for b in range(256)], np.uint8)
_TO_LINES = np.array([32 if b == 10 else 1 if b == 32 else b for b in range(256)], np.uint8)


def _is(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT, _BLANK = _is(SYMBOLS), _is(bytes(range(65, 91))), _is(b"0123456789"), _is(_BLANKS)
_STOPS = {w.encode() for w in STOP_WORDS}


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a piece (UTF-8 bytes and the offsets of the texts in them).

    n_chars are characters; n_words are runs of other than blanks (space, tab, line feed, vertical tab, form feed,
    carriage return); mean_word is characters a word; symbol_rate, capital_rate (A-Z and U+00C0 to U+00DE but U+00D7)
    and digit_rate are a character; distinct_words, line_rate (lines that aren't empty) and stop_marks (full stops) are
    a word; stop_rate is the share of STOP_WORDS that occur, of as many as there are words at most; distinct_lines
    is a line; last_mark is 1 where the last character but blanks is one of .!? Texts without words have zeros where
    nothing is counted. Words and lines are told apart by their bytes."""
    n, raw = len(at) - 1, data.tobytes()
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[at] = True

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[at]).astype(float)

    def spans(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many spans each row has, how many distinct ones, and how many distinct stop words."""
        starts, ends, rows = word_spans(table[data], at)
        if not len(starts):
            return np.zeros(n), np.zeros(n), np.zeros(n)
        code, first = distinct_spans(data, starts, ends)
        is_stop = np.array([raw[s:e] in _STOPS for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        each = np.unique(rows * len(first) + code)
        owner, stop = each // len(first), is_stop[each % len(first)]
        return tuple(np.bincount(r, minlength=n).astype(float) for r in (rows, owner, owner[stop]))

    high = np.zeros(len(data), dtype=bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    chars = per_row((data & 0xC0) != 0x80)
    words, distinct, stops = spans(_TO_BLANK)
    lines, distinct_lines, _ = spans(_TO_LINES)
    full = np.flatnonzero(~_BLANK[data])
    last = np.searchsorted(full, at[1:]) - 1
    ends = np.where((last >= 0) & (words > 0), full[last] if len(full) else 0, 0)
    mark = _is(b".!?")[data[ends]] & (words > 0) if len(data) else np.zeros(n, bool)
    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    return np.column_stack([
        chars, words, chars / w, per_row(_SYMBOL[data]) / c, per_row(_CAPITAL[data] | high) / c,
        per_row(_DIGIT[data]) / c, distinct / w, stops / np.minimum(w, len(STOP_WORDS)), lines / w,
        distinct_lines / np.maximum(lines, 1), per_row(data == 46) / w, mark,
    ])


def with_stats(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """df with a column for each of NAMES, each name with the prefix; all are doubles, never null. A null text counts as
    empty. All columns of df pass through the tasks that count, so that no join brings them together again."""
    place = [c.lower() for c in df.columns].index(text_col.lower())
    kind = T.StructType([*df.schema.fields, *[T.StructField(prefix + n, T.DoubleType()) for n in NAMES]])
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(place)
            text = text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else pc.cast(text, "string")
            data, at = buffers(text)
            parts = [statistics(data[at[s] : at[e]], at[s : e + 1] - at[s]) for s, e in pieces(at)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            counted = [pa.array(np.ascontiguousarray(values[:, j])) for j in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([*b.columns, *counted], names=names)

    return map_texts(df, run, kind)
