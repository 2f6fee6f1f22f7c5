from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tidemark.llm import token_files
from tidemark.llm.common import buffers, distinct_spans, span_hashes
from tidemark.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


def test_encoder_equals_the_library():
    whole = tokenizers.Tokenizer.from_file(tokenizer_file())
    rng = random.Random(1)
    bits = ["a", "B", " ", "\n", " ", "  ", "\t", "é", " ", " ", " ", "'s", "'ll", "1", "22", "!", "$$", "<|endoftext|>", "日本", "\r\n", "don't", "ß", "\x1c", "Ⅷ", "​", "word.", "x y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "\n"]
    tool = token_files.Encoder(tokenizer_file(), most=50)  # forgets often
    data, at = buffers(pa.array(texts))
    ids, counts = tool.rows(data, at, 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def colliding_words():
    """Two words of a and b (a Thue-Morse word and its complement) that have one polynomial hash for any base."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_hash_are_told_apart():
    one, two = colliding_words()
    data = np.frombuffer((one + two).encode(), np.uint8)
    ends = np.array([1024, 2048])
    h = span_hashes(data, ends - 1024, ends)
    assert h[0] == h[1]
    codes, first = distinct_spans(data, ends - 1024, ends)
    assert codes.tolist() == [0, 1] and first.tolist() == [0, 1]
    whole = tokenizers.Tokenizer.from_file(tokenizer_file())
    texts = [f"x {one} y {two} z {one}", f"{two} {two}", one]
    ids, counts = token_files.Encoder(tokenizer_file()).rows(*buffers(pa.array(texts)), 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_very_long_words_and_texts():
    whole = tokenizers.Tokenizer.from_file(tokenizer_file())
    texts = ["a" * 30_000, "xyz" * 4_000 + " end", "w " * 300_000]
    ids, counts = token_files.Encoder(tokenizer_file()).rows(*buffers(pa.array(texts)), 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_writer_holds_less_than_two_batches(tmp_path):
    out = token_files._Writer(str(tmp_path / "x" / "0.arrow"), np.dtype("<u2"), 16, 4)
    for k in range(100):
        out.add(np.arange(k, dtype="<u2"))
        assert out.held < 64
    out.close()
    file = token_files.Shard(str(tmp_path / "x" / "0.arrow"))
    total = sum(range(100))
    assert len(file) == -(-total // 16)
    assert (file.span(0, total) == np.concatenate([np.arange(k) for k in range(100)])).all()


def test_round_trip(spark, tmp_path):
    docs = cases.documents(spark)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, tokenizer_file(), path, length=64, per_batch=4, shards=3)
    got = token_files.read_tokens(spark, path).collect()
    whole = tokenizers.Tokenizer.from_file(tokenizer_file())
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in rows]
    want = [(r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids)]
    assert cases.key(got, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=lambda t: tuple((v is not None, v or 0) for v in t))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_start])[:-1]]).tolist()
    kept = [r.doc_id for r in by_start if r.doc_id is not None]
    assert kept == sorted(kept) and by_start[0].doc_id is None


def test_shards_give_equal_sequences_and_masks(spark, tmp_path):
    docs = cases.documents(spark, 12)
    path = str(tmp_path / "tokens")
    index = token_files.write_tokens(docs, tokenizer_file(), path, length=32, per_batch=3, shards=2).collect()
    total = 0
    for shard in {r.shard for r in index}:
        file = token_files.Shard(f"{path}/shards/{shard:06d}.arrow")
        parts = [file[i] for i in range(len(file))]
        assert all(len(ids) == 32 and len(mask) == 32 for ids, mask in parts)
        real = sum(mask.true_count for _, mask in parts)
        assert real == sum(r.n_tokens for r in index if r.shard == shard)
        flat = np.concatenate([ids for ids, _ in parts])
        assert (file.span(0, real) == flat[:real]).all() and not flat[real:].any()
        assert parts[0][0].base is not None  # a view of the mapped file
        with pytest.raises(IndexError):
            file[len(file)]
        total += real
    assert total == sum(r.n_tokens for r in index)


def test_empty_table(spark):
    assert token_files.token_table(cases.empty(spark), tokenizer_file()).collect() == []
