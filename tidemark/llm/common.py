"""Helpers that the operators of this package share: the shared folder, tables written there, and
splitting whole Arrow batches of text into words at byte level."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import Scratch, materialise, new_path  # noqa: F401  for the operators of this package


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text"):
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of a batch of whole texts that a task has in Arrow at a time.
BATCH_BYTES = 8 << 20


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) for rows that hold whole texts. A session that allows larger batches (Spark's default is 64 MB, which
    JVM and Python each hold more than once) is set to BATCH_BYTES; a longer text is a batch of its own."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return rows.mapInArrow(lambda batches: _tidied(run(batches)), schema)


def _tidied(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at the end the memory that the task has freed goes back to the system, since its process waits for others."""
    try:
        yield from out
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


#: Bytes of lower-cased words: ASCII letters and digits, and all of UTF-8 beyond ASCII; the rest becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _tables or len(_tables[key]) < n:
        _tables[key] = _powers(base, max(n, 2 * PIECE))
    return _tables[key]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit numbers of the spans of a byte array, equal for equal bytes. Unequal spans can be made to collide, so they only put
    spans together that are then compared (distinct_spans)."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table(_INVERSE, n + 1)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for spans of equal bytes, and the first span of each number.

    Spans are put together by their hashes, and then compared byte by byte with the first of their number; where any
    differs (hashes collide), the piece is numbered by the bytes themselves."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, _ = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(codes.max() + 1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    length = ends - starts
    same = length == length[first[codes]]
    if same.all():
        later = np.flatnonzero(first[codes] != np.arange(len(codes)))
        n = length[later]
        at = np.arange(n.sum()) + np.repeat(starts[later] - np.cumsum(n) + n, n)
        if (data[at] == data[at + np.repeat(starts[first[codes[later]]] - starts[later], n)]).all():
            return codes, first
    raw, known = data.tobytes(), {}
    keys = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    codes = np.array([known.setdefault(k, len(known)) for k in keys])
    first = np.empty(len(known), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (unsigned) of the bytes of each span; each distinct span of the piece is hashed once."""
    codes, first = distinct_spans(data, starts, ends)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    spans = zip(starts[first].tolist(), ends[first].tolist())
    return np.fromiter((digest(raw[s:e]) for s, e in spans), np.uint64, len(first))[codes]


def rolling(h: np.ndarray, k: int, n: int) -> np.ndarray:
    """Polynomial combinations of k hashes in a row, from each of the first n on; those that would pass the end hold what is left."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _table(_BASE, len(h))[: len(h)], out=sums[1:])
    at = np.arange(n)
    return (sums[np.minimum(at + k, len(h))] - sums[:n]) * _table(_INVERSE, n)[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them (nulls have no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row is a piece of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words in bytes translated by WORD_BYTES; words end where rows end."""
    n = len(data)
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    word = data != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edges[1:n]
    last[:-1] &= ~word[1:] | edges[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
