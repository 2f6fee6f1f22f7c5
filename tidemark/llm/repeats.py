"""Long repeated spans by compaction of a De Bruijn graph over words.

A window of k words is an edge, from the node of its first k - 1 words to that of its last k - 1. Edges that only one
document has don't matter, so the graph holds the repeated ones:

1. *Anchors.* Of the m-word sequences of a window the one with the least hash is its anchor; equal windows have equal anchors, and
   neighbours mostly share theirs. Anchors are dealt into buckets, and those that more than one document has are kept.
2. *Edges.* Windows with such anchors, with their nodes, are dealt by anchor, so that all equal ones meet. A window that several
   documents have is an edge of the graph; its source is its place in the document with the least id. Windows that follow
   one another around one anchor travel as one row, and one whose text a task has seen already stays out of the shuffle.
3. *Compaction.* A node that one edge enters and one leaves joins the two. Joins over nodes find all others, which cut the
   runs of the sources into segments, and the nodes that lead from one source to another; segments so linked are one path.
4. *Verification.* Places of documents are met with the segments through the coordinates of their sources. The words of each such
   place are compared, by a cryptographic digest, with the words at its source's coordinates; if any differs (64-bit hashes of
   different windows were equal), all is done again with hashes of another seed. Only then are words removed.

Every text is read whole. Nothing is gathered by a key that a large part of the table can share: a task sends an anchor for
two documents at most, and a window's text once. Texts are shuffled twice, compressed: for the windows, and at the end, where
those of which nothing is repeated stay out (a filter of a fixed size tells most of them).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import Scratch, buffers, map_texts, materialise, pieces, rolling, text_of, word_hashes, word_spans

#: Words are separated by these bytes.
BLANKS = b" \t\n\v\f\r"
_TABLE = np.array([32 if b in BLANKS else b for b in range(256)], np.uint8)
_BLANKED = _TABLE.tobytes()
#: Size of the filter of texts of which something is repeated.
BITS = 1 << 27
#: Words of an anchor (m) at most; windows of fewer words have anchors of half of them.
ANCHOR = 6
#: Bytes of text for each bucket of anchors, and for each part of the windows.
BUCKET_BYTES, PART_BYTES = 32 << 20, 8 << 20
#: Anchors, and places of windows, that a task holds before it sends them.
ANCHORS_HELD, PLACES_HELD = 1 << 21, 1 << 18
_SIX = (1 << 48) - 1
#: Words of a stretch of a source over which places and segments meet.
STRETCH = 64
_PLACE = ["id", "h", "pos", "n", "src_id", "src_h", "src_pos"]


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def packed(docs: DataFrame, id_col: str, text_col: str, told: bool, touched: np.ndarray | None = None) -> DataFrame:
    """(id, h, size, z, n_words, kept): the id, where texts of an id have to be told apart the first 64 bits of the text's SHA-256 (else 0), and the text (UTF-8),
    compressed. A null text counts as empty. With touched (the bits of `touched_bits`), rows whose bit is not set have their number of words and
    the digest of these instead of a text."""
    sent = None if touched is None else docs.sparkSession.sparkContext.broadcast(touched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            raw, at = data.tobytes(), at.tolist()
            texts = [raw[s:e] for s, e in zip(at, at[1:])]
            h = np.array([_digest(t) for t in texts] if told else np.zeros(len(texts)), np.int64)
            keep = np.ones(len(texts), bool)
            if sent is not None:
                bit = b.column(0).fill_null(0).to_numpy() % BITS
                keep = (sent.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                keep &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            z = [pa.compress(t, codec="zstd", asbytes=True) if k else None for t, k in zip(texts, keep.tolist())]
            words = [None if k else _words(t) for t, k in zip(texts, keep.tolist())]
            kept = [None if w is None else hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            counts = [None if w is None else len(w) for w in words]
            columns = [b.column(0), pa.array(h), pa.array([len(t) for t in texts], pa.int64()), pa.array(z, pa.binary()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "size", "z", "n_words", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return map_texts(rows, run, "id long, h long, size long, z binary, n_words long, kept string")


def touched_bits(places: DataFrame) -> np.ndarray:
    """A bit for each remainder of an id by BITS: set where a place or a source has it. So many bits tell apart most ids of some ten million; with more of
    them the filter lets more through, and in the end all."""
    ids = places.select(F.explode(F.array("id", "src_id")).alias("id"))
    bit = F.pmod("id", F.lit(BITS))
    words = ids.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    out = np.zeros(BITS >> 6, np.int64)
    found = words.toPandas()  # at most BITS / 64 rows
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _words(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_BLANKED).split(b" ") if w]


def _unpacked(b: pa.RecordBatch) -> list[bytes | None]:
    sizes, z = b.column(b.schema.get_field_index("size")).to_pylist(), b.column(b.schema.get_field_index("z"))
    return [pa.decompress(x.as_py(), n, codec="zstd", asbytes=True) if x.is_valid else None for x, n in zip(z, sizes)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(data: np.ndarray, at: np.ndarray, k: int, seed: int, with_nodes: bool = True) -> tuple[np.ndarray, ...]:
    """For the windows of a piece, in order: row, place of the first word in its text, hash of the anchor and the place of the anchor in the piece;
    last the places of the first words in the piece and, if asked for, the hashes of all nodes there."""
    data = _TABLE[data]
    starts, ends, rows = word_spans(data, at)
    n = len(starts)
    if n < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    h = _mixed(word_hashes(data, starts, ends) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    m = min(ANCHOR, max(1, k // 2))
    grams = _mixed(rolling(h, m, n))
    least, where = grams[: n - k + 1].copy(), np.arange(n - k + 1)
    for j in range(1, k - m + 1):
        other = grams[j : j + n - k + 1]
        less = other < least
        least[less], where[less] = other[less], np.flatnonzero(less) + j
    whole = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
    per = np.bincount(rows, minlength=len(at) - 1)
    first = np.cumsum(per) - per
    nodes = _mixed(rolling(h, k - 1, n)) if with_nodes else grams[:0]
    return rows[whole], whole - first[rows[whole]], least[whole], where[whole], whole, nodes


def _short_pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of fewer than 2^16 rows."""
    for first, last in pieces(at):
        for s in range(first, last, 1 << 15):
            yield s, min(last, s + (1 << 15))


def _key_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _short(h):
    """32 bits of h, which tell apart the texts of one id (if they don't, both are asked for the anchors of either)."""
    return h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def anchors(docs: DataFrame, buckets: int, k: int, seed: int, id_col: str, text_col: str, told: bool) -> DataFrame:
    """(bucket, ids, marks, counts, keys): for rows of one bucket (or, if it is negative, of any) that are known to be shared ids, bits of the texts' digests,
    the number of each one's anchors and, in turn, six bytes of each anchor's hash."""

    def packs(key: np.ndarray, ids: np.ndarray, marks: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        key = key & np.uint64(_SIX)
        order = np.lexsort((marks, ids, key))
        key, ids, marks = key[order], ids[order], marks[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
        key, ids, marks, new_key = key[new], ids[new], marks[new], new_key[new]
        start = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))
        # A second document of an anchor: the first of its rows with another id.
        differs = ids != ids[start]
        seen = np.cumsum(differs)
        second = differs & (seen == seen[start] + 1)
        several = np.zeros(len(key), bool)
        several[start[second]] = True
        known = several[start] & ~new_key & ~second
        bucket = np.where(known, -1 - turn % buckets, (key % np.uint64(buckets)).astype(np.int64))
        order = np.lexsort((marks, ids, bucket))
        key, ids, marks, bucket = key[order], ids[order], marks[order], bucket[order]
        doc = np.ones(len(key), bool)
        doc[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (bucket[1:] != bucket[:-1])
        doc = np.flatnonzero(doc)
        part = np.flatnonzero(np.diff(bucket[doc], prepend=bucket[doc[0]] - 1))
        offsets = pa.array(np.append(part, len(doc)).astype(np.int32))
        sizes = np.diff(np.append(doc, len(key)))
        six, edges = _key_bytes(key), np.append(doc[part], len(key)).tolist()
        columns = [
            pa.array(bucket[doc[part]].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(ids[doc])),
            pa.ListArray.from_arrays(offsets, pa.array(marks[doc])),
            pa.ListArray.from_arrays(offsets, pa.array(sizes.astype(np.int32))),
            pa.array([six[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "ids", "marks", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for b in batches:
            data, at = buffers(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            spans = zip(at.tolist(), at.tolist()[1:])
            marks = np.array([_digest(raw[s:e]) & 0x7FFFFFFF for s, e in spans] if told else np.zeros(b.num_rows), np.int32)
            for s, e in pieces(at):
                row, _, key, where, _, _ = windows(data[at[s] : at[e]], at[s : e + 1] - at[s], k, seed, False)
                new = np.ones(len(row), bool)
                new[1:] = where[1:] != where[:-1]
                held.append((key[new], ids[s + row[new]], marks[s + row[new]]))
                size += int(new.sum())
            if size > ANCHORS_HELD:
                yield from packs(*(np.concatenate(c) for c in zip(*held)), turn)
                held, size, turn = [], 0, turn + 1
        if size:
            yield from packs(*(np.concatenate(c) for c in zip(*held)), turn)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).filter("id IS NOT NULL")
    return map_texts(rows, run, "bucket int, ids array<long>, marks array<int>, counts array<int>, keys binary")


def shared_anchors(dealt: DataFrame, buckets: int) -> DataFrame:
    """(id, mark, key): the anchors of documents that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, marks, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        for b in batches:
            for i in range(b.num_rows):
                counts = b.column(3)[i].values.to_numpy()
                key.append(_keys(b.column(4)[i].as_py()))
                ids.append(np.repeat(b.column(1)[i].values.to_numpy(), counts))
                marks.append(np.repeat(b.column(2)[i].values.to_numpy(), counts))
                known.append(np.full(len(key[-1]), b.column(0)[i].as_py() < 0))
        key, ids, marks, known = (np.concatenate(c) for c in (key, ids, marks, known))
        if not len(key):
            return
        order = np.lexsort((ids, key, known))
        key, ids, marks, known = key[order], ids[order], marks[order], known[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (known[1:] != known[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(key))
        several = ids[end - 1] != ids[start]
        keep = np.repeat(several, end - start) | known
        # Rows of a document stand together, which makes them small when they are shuffled.
        key, ids, marks = key[keep], ids[keep], marks[keep]
        order = np.lexsort((marks, ids))
        columns = [pa.array(c[order]) for c in (ids, marks, key.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "key"])

    return dealt.repartition(buckets, "bucket").mapInArrow(run, "id long, mark int, key long")


_HEAD, _HEAD_BYTES = "<qqqii", 32


def _merged(places: list[tuple]) -> list[tuple]:
    """Places (id, h, pos, n, src_id, src_h, src_pos) of a task that follow one another, in a text and in its source, as one."""
    out: list[list] = []
    for i, h, pos, n, si, sh, sp in sorted(places, key=lambda p: (p[0], p[1], p[4], p[5], p[6] - p[2], p[2])):
        if out and out[-1][:2] == [i, h] and out[-1][4:6] == [si, sh] and out[-1][6] - out[-1][2] == sp - pos and pos <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], pos + n - out[-1][2])
        else:
            out.append([i, h, pos, n, si, sh, sp])
    return out


def runs(texts: DataFrame, shared: DataFrame, k: int, seed: int) -> DataFrame:
    """(key, run, *_PLACE). With run: windows in a row around one anchor (key), once for each text that a task has of the least id: id, h, the greatest id that has it, the
    numbers of places and of windows (_HEAD), the places, and six bytes of each node's hash. Else: other places of the task, with that one as
    their source; their key is any number."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def sent(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[int, bytes]] = []
        other: list[tuple] = []
        for content, (key, places) in held.items():
            n = len(content) // 6 - 1
            least, most = min(p[0] for p in places), max(p[0] for p in places)
            own: dict[int, list[int]] = {}
            for i, h, pos in places:
                if i == least:
                    own.setdefault(h, []).append(pos)
            source, first = next(iter(own.items()))
            whole += [(key, struct.pack(_HEAD, least, h, most, len(at), n) + np.array(at, "<i4").tobytes() + content) for h, at in own.items()]
            other += [(i, h, pos, n, least, source, first[0]) for i, h, pos in places if i != least]
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(zip(*part), kinds)), *(pa.nulls(len(part), kind) for kind in kinds[2:])], names=["key", "run", *_PLACE])
        other = _merged(other)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            keys = [p[0] ^ p[2] for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(part), pa.binary()), *(pa.array(c, kind) for c, kind in zip(zip(*part), kinds[2:]))], names=["key", "run", *_PLACE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, done = 0, set()
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            wanted, all_texts = b.column(b.schema.get_field_index("keys")), _unpacked(b)
            fresh_rows = []
            for i, doc in enumerate(zip(ids, hs)):
                if doc not in done:
                    done.add(doc)
                    fresh_rows.append(i)
            at = np.cumsum([0, *(len(all_texts[i]) for i in fresh_rows)])
            data = np.frombuffer(b"".join(all_texts[i] for i in fresh_rows), np.uint8)
            for s, e in _short_pieces(at):
                row, place, anchor, where, word, nodes = windows(data[at[s] : at[e]], at[s : e + 1] - at[s], k, seed)
                # Rows of a piece are told apart in the upper bits.
                of = [wanted[i].values.to_numpy().view(np.uint64) | np.uint64((j - s) << 48) for j, i in enumerate(fresh_rows[s:e], s)]
                if not of or not len(row):
                    continue
                keep = np.isin((anchor & np.uint64(_SIX)) | (row.astype(np.uint64) << np.uint64(48)), np.concatenate(of))
                row, place, anchor, where, word = row[keep], place[keep], anchor[keep], where[keep], word[keep]
                new = np.ones(len(row), bool)
                new[1:] = (where[1:] != where[:-1]) | (word[1:] != word[:-1] + 1)
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(row)))
                six = _key_bytes(nodes)
                values = zip(row[start].tolist(), place[start].tolist(), anchor[start].view(np.int64).tolist(), word[start].tolist(), n.tolist())
                for r, pos, key, w, count in values:
                    content = six[w : w + count + 1].tobytes()
                    i = fresh_rows[s + r]
                    held.setdefault(content, [key, []])[1].append((ids[i], hs[i], pos))
                size += len(start)
                if size > PLACES_HELD:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    asked = shared.groupBy("id", "mark").agg(F.collect_list("key").alias("keys"))
    rows = texts.filter("id IS NOT NULL").withColumn("mark", _short(F.col("h"))).join(asked, ["id", "mark"])
    schema = "key long, run binary, id long, h long, pos int, n int, src_id long, src_h long, src_pos int"
    return map_texts(rows.select("id", "h", "size", "z", "keys"), run, schema)


def _opened(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of runs: ids, h, greatest ids, numbers of places and of windows, all places, all nodes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    head = raw[at[:-1, None] + np.arange(_HEAD_BYTES)].reshape(len(column), -1)
    ids, hs, most = (np.ascontiguousarray(head[:, 8 * j : 8 * j + 8]).view("<i8")[:, 0] for j in range(3))
    many, n = (np.ascontiguousarray(head[:, 24 + 4 * j : 28 + 4 * j]).view("<i4")[:, 0].astype(np.int64) for j in range(2))

    def items(begin: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
        first = np.repeat(begin - width * (np.cumsum(counts) - counts), counts) + width * np.arange(counts.sum())
        return raw[first[:, None] + np.arange(width)]

    places = np.ascontiguousarray(items(at[:-1] + _HEAD_BYTES, many, 4)).view("<i4")[:, 0].astype(np.int64)
    nodes = np.zeros(((n + 1).sum(), 8), np.uint8)
    nodes[:, :6] = items(at[:-1] + _HEAD_BYTES + 4 * many, n + 1, 6)
    return ids, hs, most, many, n, places, nodes.view("<i8")[:, 0]


_FOUND = "kind int, id long, h long, pos int, n int, src_id long, src_h long, src_pos int, nodes array<long>"


def edges(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows of _FOUND. Kind 1: places of tasks, as they came. Kind 2: windows in a row that a document with a smaller id has, and where its (least) source
    has them. Kind 3: windows in a row of a source (id, h, pos), with their nodes: the edges of the graph, each once. Kind 4: windows that the source's document has again elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        held = []
        for b in batches:
            t = pa.Table.from_batches([b])
            other = t.filter(t.column("run").is_null())
            if other.num_rows:
                kind, none = pa.array(np.ones(other.num_rows, np.int32)), pa.nulls(other.num_rows, pa.list_(pa.int64()))
                yield from pa.table([kind, *(other.column(c) for c in _PLACE), none], names=names).to_batches()
            held.append(t.column("run").drop_null())
        whole = pa.chunked_array([c for x in held for c in x.chunks], pa.binary()).combine_chunks()
        if not len(whole):
            return
        ids, hs, most, many, n, places, nodes = _opened(whole)
        first_place = np.cumsum(many) - many
        at = np.cumsum(n + 1) - (n + 1)  # of a row's first node
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        left, right = nodes[at[row] + step], nodes[at[row] + step + 1]
        pos = places[first_place[row]] + step
        order = np.lexsort((pos, hs[row], ids[row], right, left))
        new = np.ones(len(order), bool)
        new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(order))
        source = np.empty(len(order), np.int64)  # of each edge the edge that is its source, by number
        source[order] = np.repeat(order[start], end - start)
        several = np.maximum.reduceat(most[row[order]], start) != ids[row[order[start]]]
        repeated = np.empty(len(order), bool)
        repeated[order] = np.repeat(several, end - start)
        later = repeated & (ids[row] != ids[row[source]])
        own = repeated & (source == np.arange(len(source)))

        def stretches(chosen: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            """First edges and lengths of chosen edges in a row (of one text, with sources in a row)."""
            e = np.flatnonzero(chosen)
            cut = np.ones(len(e), bool)
            cut[1:] = (e[1:] != e[:-1] + 1) | (row[e[1:]] != row[e[:-1]])
            if by is not None:
                cut[1:] |= (row[by[e[1:]]] != row[by[e[:-1]]]) | (pos[by[e[1:]]] != pos[by[e[:-1]]] + 1)
            s = np.flatnonzero(cut)
            return e[s], np.diff(np.append(s, len(e)))

        e, count = stretches(later, source)
        of = np.repeat(np.arange(len(e)), many[row[e]])  # once for each place of the text
        which = np.arange(len(of)) - np.repeat(np.cumsum(many[row[e]]) - many[row[e]], many[row[e]])
        e, count = e[of], count[of]
        here = places[first_place[row[e]] + which] + step[e]
        src = source[e]
        columns = [np.full(len(e), 2), ids[row[e]], hs[row[e]], here, count, ids[row[src]], hs[row[src]], pos[src]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.nulls(len(e), pa.list_(pa.int64()))], names=names)
        # First places of other texts, or of the same, of the source's document.
        e, count = stretches(repeated & ~later & ~own, source)
        src = source[e]
        columns = [np.full(len(e), 4), ids[row[e]], hs[row[e]], pos[e], count, ids[row[src]], hs[row[src]], pos[src]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.nulls(len(e), pa.list_(pa.int64()))], names=names)
        e, count = stretches(own)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(count + 1)).astype(np.int32)),
            pa.array(nodes[np.repeat(at[row[e]] + step[e], count + 1) + np.arange((count + 1).sum()) - np.repeat(np.cumsum(count + 1) - count - 1, count + 1)]),
        )
        columns = [pa.array(c, k) for c, k in zip([np.full(len(e), 3), ids[row[e]], hs[row[e]], pos[e], count], kinds)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(e), k) for k in kinds[5:]), lists], names=names)

    return map_texts(dealt.repartition(parts, "key"), run, _FOUND)


def segments(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, id, h, pos, n): the graph's edges (rows of kind 3) as nonbranching segments of their sources, and the least segment of each path."""
    last = (F.size("nodes") - 1).cast("int").alias("last")
    nodes = chains.select("id", "h", F.col("pos").alias("chain"), last, F.posexplode("nodes").alias("i", "node")).repartition("node")
    enters, leaves = (F.col("i") > 0).cast("int"), (F.col("i") < F.col("last")).cast("int")
    spot = F.struct("id", "h", (F.col("chain") + F.col("i")).alias("pos"))
    whole = Window.partitionBy("node")
    nodes = nodes.select(
        "node", "id", "h", "chain", "last", "i", spot.alias("spot"),
        ((F.sum(enters).over(whole) == 1) & (F.sum(leaves).over(whole) == 1)).alias("simple"),
        F.max(F.when(enters == 1, spot)).over(whole).alias("entered"), F.max(F.when(leaves == 1, spot)).over(whole).alias("left"),
    )
    # The ends of the chains, and nodes within where edges meet or part.
    breaks = nodes.filter("NOT simple OR i = 0 OR i = last")
    smooth = F.col("simple") & (F.col("entered") == F.col("spot")) & (F.col("left") == F.col("spot"))
    breaks = scratch.write(breaks.withColumn("smooth", smooth), "breaks")
    along = Window.partitionBy("id", "h", "chain").orderBy("i")
    parts = breaks.select("id", "h", (F.col("chain") + F.col("i")).alias("pos"), (F.lead("i").over(along) - F.col("i")).alias("n"), "smooth")
    parts = parts.filter("n > 0")
    text = Window.partitionBy("id", "h").orderBy("pos")
    joined = F.col("smooth") & (F.lag(F.col("pos") + F.col("n")).over(text) == F.col("pos"))
    parts = parts.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("g", F.sum("new").over(text))
    rows = parts.groupBy("id", "h", "g").agg(F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"))
    rows = scratch.write(rows.select(F.monotonically_increasing_id().alias("segment"), "id", "h", "pos", "n"), "segments")
    links = breaks.filter("simple AND NOT smooth AND i = last").select("entered", "left")
    ends = rows.select(F.struct("id", "h", (F.col("pos") + F.col("n")).alias("pos")).alias("entered"), F.col("segment").alias("a"))
    starts = rows.select(F.struct("id", "h", "pos").alias("left"), F.col("segment").alias("b"))
    links = links.join(ends, "entered").join(starts, "left").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = simhash.components(scratch.write(links.distinct(), "links"), scratch).withColumnRenamed("node", "segment")
    rows = rows.join(roots, "segment", "left").select(F.coalesce("root", "segment").alias("path"), "id", "h", "pos", "n")
    return scratch.write(rows, "paths")


def merged(places: DataFrame) -> DataFrame:
    """Places (_PLACE) that follow one another, in a text and in its source, as one."""
    keys = ["id", "h", "src_id", "src_h", "shift"]
    rows = places.withColumn("shift", F.col("src_pos") - F.col("pos"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("pos") > F.coalesce(F.max(F.col("pos") + F.col("n")).over(before), F.lit(-1))).cast("int")
    rows = rows.withColumn("new", new).withColumn("g", F.sum("new").over(Window.partitionBy(*keys).orderBy("pos")))
    rows = rows.groupBy(*keys, "g").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("n")).alias("end"))
    return rows.select("id", "h", "pos", (F.col("end") - F.col("pos")).alias("n"), "src_id", "src_h", (F.col("shift") + F.col("pos")).alias("src_pos"))


def on_paths(places: DataFrame, known: DataFrame) -> DataFrame:
    """places cut where the stretches in known (path, id, h, pos, n) end that their sources lie on, with the path of each. They meet over the blocks of
    the source that both touch, and each pair is taken in the block where what they share begins."""
    upto = lambda a, n: F.explode(F.sequence(F.floor(a / STRETCH), F.floor((a + n - 1) / STRETCH))).alias("block")
    left = places.select(*_PLACE, upto(F.col("src_pos"), F.col("n")))
    right = known.select("path", F.col("id").alias("src_id"), F.col("h").alias("src_h"), F.col("pos").alias("at"), F.col("n").alias("m"), upto(F.col("pos"), F.col("n")))
    begin, end = F.greatest("src_pos", "at"), F.least(F.col("src_pos") + F.col("n"), F.col("at") + F.col("m"))
    met = left.join(right, ["src_id", "src_h", "block"]).withColumn("begin", begin).withColumn("end", end)
    met = met.filter((F.col("begin") < F.col("end")) & (F.col("block") == F.floor(F.col("begin") / STRETCH)))
    moved = F.col("pos") + F.col("begin") - F.col("src_pos")
    return met.select("id", "h", moved.alias("pos"), (F.col("end") - F.col("begin")).alias("n"), "src_id", "src_h", F.col("begin").alias("src_pos"), "path")


_OUT = "kind int, id long, h long, n_words long, n_removed long, kept string, pos int, n int, src_id long, src_h long, src_pos int, digest binary"


def cut(texts: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Rows of _OUT. Kind 0: for each row of texts (see `packed`) its words, how many the places (_PLACE) cover and the digest of the rest. Kinds 1 and 2: digests
    of the words of each place and of each source."""
    todo = F.struct("pos", "n", "src_id", "src_h", "src_pos")
    asked = places.select(F.col("src_id").alias("id"), F.col("src_h").alias("h"), F.col("src_pos").alias("pos"), "n").distinct()
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("src_id", "long"), ("src_h", "long"), ("src_pos", "int"))]
    rows = places.select(*_PLACE).unionByName(asked.select("*", *nothing)).groupBy("id", "h").agg(F.collect_list(todo).alias("todo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            of = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            for i, h, text, tasks, n_words, known in zip(of("id"), of("h"), _unpacked(b), b.column(b.schema.get_field_index("todo")), of("n_words"), of("kept")):
                if text is None:
                    out.append((0, i, h, n_words, 0, known, None, None, None, None, None, None))
                    continue
                words = _words(text)
                change = np.zeros(len(words) + 1, np.int64)
                for t in tasks.as_py() or ():
                    s, e = t["pos"], t["pos"] + t["n"] + k - 1
                    digest = hashlib.sha256(b" ".join(words[s:e])).digest()[:16]
                    source = (t["src_id"], t["src_h"], t["src_pos"])
                    out.append((1 if t["src_id"] is not None else 2, i, h, None, None, None, s, t["n"], *source, digest))
                    if t["src_id"] is not None:
                        change[s] += 1
                        change[e] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = [words[j] for j in np.flatnonzero(~gone).tolist()] if gone.any() else words
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((0, i, h, len(words), len(words) - len(kept), digest, None, None, None, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[c.split()[0] for c in _OUT.split(", ")])

    rows = texts.join(rows, ["id", "h"], "left").select("id", "h", "size", "z", "n_words", "kept", "todo")
    return map_texts(rows, run, _OUT)


def differing(out: DataFrame) -> DataFrame:
    """Places whose words aren't those of their source."""
    place = out.filter("kind = 1").select("src_id", "src_h", "src_pos", "n", F.col("digest").alias("one"))
    source = out.filter("kind = 2").select(F.col("id").alias("src_id"), F.col("h").alias("src_h"), F.col("pos").alias("src_pos"), "n", F.col("digest").alias("other"))
    return place.join(source, ["src_id", "src_h", "src_pos", "n"], "left").filter(~F.col("one").eqNullSafe(F.col("other")))


def repeated_places(docs: DataFrame, scratch: Scratch, k: int, seed: int, id_col: str, text_col: str, told: bool) -> DataFrame:
    """(_PLACE, path): windows in a row of a row's text that a document with a smaller id has, the place of the source and their path. n counts windows."""
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    buckets, parts = 1 + size // BUCKET_BYTES, 1 + size // PART_BYTES
    shared = shared_anchors(anchors(docs, buckets, k, seed, id_col, text_col, told), buckets)
    found = scratch.write(edges(runs(packed(docs, id_col, text_col, told), shared, k, seed), parts), "found")
    known = segments(found.filter("kind = 3").select("id", "h", "pos", "nodes"), scratch)
    later = scratch.write(on_paths(merged(found.filter("kind = 2").select(*_PLACE)), known), "later")
    again = on_paths(merged(found.filter("kind = 4").select(*_PLACE)), known)
    near = merged(found.filter("kind = 1").select(*_PLACE))
    # The source of a task's places is a source of the graph, or a place in turn.
    stretches = [x.select("path", "id", "h", "pos", "n") for x in (known, later, again)]
    near = on_paths(near, stretches[0].unionByName(stretches[1]).unionByName(stretches[2]))
    return scratch.write(later.unionByName(near), "places")


def _verified(docs: DataFrame, k: int, id_col: str, text_col: str, spans: bool) -> DataFrame:
    if k < 2:
        raise ValueError("a window has two words at least")
    # Only where an id is not a row's own do texts have to be told apart.
    told = not docs.groupBy(F.col(id_col).cast("long").alias("id")).count().filter("id IS NOT NULL AND count > 1").isEmpty()
    for seed in range(1, 6):
        with Scratch(docs.sparkSession, "repeats") as scratch:
            places = repeated_places(docs, scratch, k, seed, id_col, text_col, told)
            out = scratch.write(cut(packed(docs, id_col, text_col, told, touched_bits(places)), places, k), "cut")
            if not differing(out).isEmpty():
                continue
            if spans:
                length, source = (F.col("n") + k - 1).alias("n_words"), [F.col("src_id").alias("source_id"), F.col("src_pos").alias("source_start")]
                return materialise(places.select(F.col("id").alias(id_col), F.col("pos").alias("start"), length, "path", *source), "repeated-spans")
            return materialise(out.filter("kind = 0").select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256")), "repeats")
    raise RuntimeError("windows of different words had equal hashes for every seed")


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    Words are runs of other than ASCII blanks, as they are. Each word is removed that lies in a window of k words which starts in a
    document with a smaller id too, where windows are judged on the input. A null text has no words. Rows that repeat an id are one
    document: they remove nothing from one another; rows without an id neither remove nor lose anything. Repeated rows have
    equal results. A long text is read in one task. An empty table gives an empty result; other columns are not looked at, whatever their names."""
    return _verified(docs, k, id_col, text_col, False)


def repeated_spans(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, path, source_id, source_start) for each span that remove_repeats removes: where its words start, how many they are,
    the path of the graph they lie on, and where a document with a smaller id has the same words. Spans that follow one another overlap by k - 1
    words. Repeated rows share their spans."""
    return _verified(docs, k, id_col, text_col, True)
