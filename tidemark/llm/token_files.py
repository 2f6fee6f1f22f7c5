"""Token ids in Arrow files of equal-length sequences.

Documents are dealt by range of id, and each range becomes one shard: an Arrow file whose record batches hold a
fixed-size list of ids and one of mask bits for each sequence. The ids of a shard follow each other without gaps, each
document ended by the end id; only the last sequence is filled up, with mask bits of 0. Equal lengths make sequence i
an address, so that a memory-mapped file gives it without copying or decoding anything else. An index table says where
each document lies.

Encoding goes through the tokenizers library. Byte-level BPE never merges across the single space or line feed
that parts two words, so a text is the sum of its words; each distinct word of a piece is encoded once, and
a bounded number of words is remembered. Texts with other kinds of white space are encoded whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, distinct_spans, map_texts, new_path, pieces, text_of

#: Unicode's white space beyond ASCII, in UTF-8, and the control characters that some count as such.
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE_ODD = np.zeros(256, dtype=bool)
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE uses for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of many texts at once, equal to the library's for each text."""

    def __init__(self, tokenizer: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.most, self.known = most, {}
        self.letters = _byte_letters()
        byte_level = type(self.whole.pre_tokenizer).__name__ == "ByteLevel" and type(self.whole.model).__name__ == "BPE" and self.whole.normalizer is None
        self.by_word = byte_level and not self.whole.pre_tokenizer.add_prefix_space

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _piece(self, text: str) -> list[int]:
        """Ids of a single pre-token."""
        return [t.id for t in self.whole.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words; as many are remembered as there is room for."""
        out: list[bytes | None] = [None] * len(words)
        rest, tokenize, code = [], self.whole.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        for i, w in enumerate(words):
            if w[1:].isalpha() and (w[0] == 32 or w[:1].isalpha()):  # ASCII letters alone
                out[i] = array(code, [t.id for t in tokenize(("Ġ" if w[0] == 32 else chr(w[0])) + w[1:].decode())]).tobytes()
                continue
            text = w.decode()
            word = text[1:] if text[0] == " " else text
            stem = word.rstrip(_PUNCTUATION)
            if stem.isalpha() and max(stem) < "ɐ":
                ids = self._piece(text[: len(text) - len(word) + len(stem)])
                if len(stem) < len(word):
                    ids += self._piece(word[len(stem) :])
                out[i] = self._pack(ids)
            else:
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = self._pack(e.ids)
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        if len(words) <= self.most:
            self.known.update(zip(words, out))
        return out

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        space = _SPACE[data]
        single = space & ((data == 32) | (data == 10)) & ~edge[:n] & ~edge[1:]
        single[1:] &= ~space[:-1]
        single[:-1] &= ~space[1:]
        start = edge[:n] | single
        start[1:] |= single[:-1] & (data[:-1] == 10)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        codes, first = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        values = list(map(self.known.get, keys))
        if missing := [i for i, v in enumerate(values) if v is None]:
            for i, v in zip(missing, self._encode([keys[i] for i in missing])):
                values[i] = v
        flat = np.frombuffer(b"".join(values), dtype=self.kind)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        begins = np.cumsum(lengths) - lengths
        counts = lengths[codes]
        sums = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(counts, out=sums[1:])
        ids = flat[np.repeat(begins[codes] - sums[:-1], counts) + np.arange(sums[-1])]
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])

    def rows(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and how many each row has; with the end id after each row."""
        raw, at = data.tobytes(), offsets.tolist()
        odd = not self.by_word or bool(_MAYBE_ODD[data].any() and ODD_SPACE.search(raw))
        if not odd:
            ids, counts = self._words(data, offsets)
        else:
            parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
            for i in range(len(offsets) - 1):
                text = raw[at[i] : at[i + 1]]
                if not self.by_word or ODD_SPACE.search(text):
                    part = np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, dtype=self.kind)
                else:
                    part = self._words(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))[0]
                parts.append(part)
                counts[i] = len(part)
            ids = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), end)
            counts = counts + 1
        return ids, counts


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """This process's encoder: what it has learnt serves later tasks too."""
    return Encoder(tokenizer)


class Shard:
    """Random access to the sequences of a shard; ids and masks are views of the mapped file."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.source = pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
        self.file = pa.ipc.open_file(self.source)
        self.length, self.per = (int(self.file.schema.metadata[k]) for k in (b"length", b"per_batch"))
        n = self.file.num_record_batches  # all but the last are full
        self.size = (n - 1) * self.per + self.batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.size

    def batch(self, k: int) -> pa.RecordBatch:
        return self.file.get_batch(k)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < self.size:
            raise IndexError(i)
        b, j = self.batch(i // self.per), i % self.per
        take = slice(j * self.length, (j + 1) * self.length)
        return self._flat(b, 0)[take], b.column(1).flatten()[take]

    @staticmethod
    def _flat(b: pa.RecordBatch, column: int) -> np.ndarray:
        return b.column(column).flatten().to_numpy(zero_copy_only=True)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the shard's id number start on."""
        width = self.length * self.per
        parts = []
        while n > 0:
            k, at = divmod(start, width)
            part = self._flat(self.batch(k), 0)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


class _Writer:
    """Writes a shard as its ids come, under a name of its own, and gives it the shard's name at the end; writing it again
    gives the same file. It holds less than two batches of sequences."""

    def __init__(self, path: str, kind: np.dtype, length: int, per: int):
        self.kind, self.length, self.width = kind, length, length * per
        self.fs, self.inner = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        self.fs.create_dir(self.inner.rpartition("/")[0], recursive=True)
        self.temp = f"{self.inner}.{uuid.uuid4().hex}"
        fields = [("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(fields, metadata={"length": str(length), "per_batch": str(per)})
        self.stream = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.stream, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.width:
            flat = np.concatenate(self.parts)
            full = len(flat) // self.width * self.width
            for at in range(0, full, self.width):
                self._put(flat[at : at + self.width])
            self.parts, self.held = [flat[full:]], len(flat) - full

    def _put(self, ids: np.ndarray) -> None:
        n = len(ids)
        full = -(-n // self.length) * self.length
        if full > n:
            ids = np.concatenate([ids, np.zeros(full - n, self.kind)])
        mask = pa.array(np.arange(full) < n)
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.parts))
        self.out.close()
        self.stream.close()
        self.fs.move(self.temp, self.inner)


#: Bytes of text for a shard, about.
SHARD_BYTES = 48 << 20


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end: int = 2, length: int = 2048, per_batch: int = 64,
    id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
) -> DataFrame:
    """Write the ids of all rows of docs in ascending order of their id, as shards and an index under path; returns the index.

    Null texts are empty: they have the end id alone. Rows without an id come first. Rows that repeat an id follow each other
    by a hash of their text. An empty table writes no shard. Columns other than the id and the text are left out.
    shards: how many ranges of ids; None: as many as the bytes of the texts ask for, so that a shard's size is bounded.
    Index: shard, k (row within the shard), id, start (within the shard), n_tokens."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    order = [F.col("id").asc_nulls_first(), "h"]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tool, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        start = k = 0
        for b in batches:
            data, at = buffers(b.column(1))
            for first, last in pieces(at):
                ids, counts = tool.rows(data[at[first] : at[last]], at[first : last + 1] - at[first], end)
                out = out or _Writer(f"{path}/shards/{shard:06d}.arrow", tool.kind, length, per_batch)
                out.add(ids)
                n, begins = last - first, start + np.cumsum(counts) - counts
                own = [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(k, k + n)), b.column(0).slice(first, n)]
                names = ["shard", "k", "id", "start", "n_tokens"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(begins), pa.array(counts)], names=names)
                start, k = start + len(ids), k + n
        if out:
            out.close()

    index = map_texts(rows, run, "shard int, k long, id long, start long, n_tokens long")
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files under path: id, start (ids before it in all shards), n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        file = Shard(f"{path}/shards/{shard:06d}.arrow")
        rows = rows.sort_values("k")
        spans = zip(rows["start"].tolist(), rows["n_tokens"].tolist())
        rows["ids_crc32"] = [zlib.crc32(file.span(s, n).astype("<u4").tobytes()) for s, n in spans]
        return rows[["shard", "id", "start", "n_tokens", "ids_crc32"]].astype({"id": "Int64"})

    read = index.groupBy("shard").applyInPandas(run, "shard int, id long, start long, n_tokens long, ids_crc32 long")
    return read.join(before, "shard").select(F.col("id").alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")


def token_table(
    docs: DataFrame, tokenizer: str, end: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write docs to a new folder of the shared one, and read the files back.

    Null texts are empty; a text of any length is encoded whole, in one task, and lies over as many sequences as it fills. Rows that repeat an id are
    each written; ties are ordered by a hash of the text. An empty table gives an empty result; other columns are left out, whatever their names."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end, length, id_col=id_col, text_col=text_col)
    return read_tokens(docs.sparkSession, path, id_col)
