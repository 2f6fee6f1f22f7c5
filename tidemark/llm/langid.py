"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of orders 1 to `order` (presence, not counts), hashed into `width` columns.
The kernel of two texts is the cosine of their sets. Ridge regression for each language against the rest is fitted in
the span of landmark texts (Nyström): the weights of the landmarks are folded into one matrix of columns by
languages, so that a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, crc_mod, map_texts, text_of

_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
_FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    _FOLD[_c] = ord(chr(_c).lower()[0]) if chr(_c).isalpha() else 32


def grams(texts: list[str], width: int, order: int) -> np.ndarray:
    """0/1 rows of the hashed n-grams of each text: letters in lower case, all else below U+0250 as a space."""
    out = np.zeros((len(texts), width), dtype=np.uint8)
    for i, text in enumerate(texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not len(c):
            continue
        low = c < 0x250
        c = np.where(low, _FOLD[np.where(low, c, 0)], c).astype(np.uint32)
        row, h = out[i], np.zeros(len(c), dtype=np.uint32)
        for k in range(min(order, len(c))):
            h = (h[: len(c) - k] + c[k:]) * _MIX[k % 4] if k == 0 else (h[:-1] * np.uint32(31) + c[k:]) * _MIX[k % 4]
            row[(h ^ (h >> np.uint32(15))) % np.uint32(width)] = 1
    return out


@dataclass(frozen=True)
class KernelModel:
    """weights: a row for each hashed n-gram, a column for each language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    order: int

    def decide(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(1, present.sum(axis=1, dtype=np.int64)))
        return (present.astype(np.float32) @ self.weights) / norm[:, None]


def fit(present: np.ndarray, langs: np.ndarray, order: int, landmarks: int = 240, ridge: float = 1e-3) -> KernelModel:
    """Ridge regression of one language against the rest on the kernel with landmarks: the first rows of each language in turn."""
    languages = sorted(set(langs))
    if not languages:
        return KernelModel((), np.zeros((present.shape[1], 0), np.float32), order)
    norm = np.sqrt(np.maximum(1, present.sum(axis=1, dtype=np.int64)))[:, None]
    x = present.astype(np.float32) / norm.astype(np.float32)
    turn = pd.Series(langs).groupby(langs).cumcount().to_numpy()
    z = x[np.argsort(turn, kind="stable")[:landmarks]]
    k = (x @ z.T).astype(np.float64)
    y = np.where(langs[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    a = k.T @ k + ridge * len(x) * (z @ z.T) + 1e-8 * np.eye(len(z))
    alpha = np.linalg.solve(a, k.T @ y)
    return KernelModel(tuple(languages), (z.T.astype(np.float64) @ alpha).astype(np.float32), order)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1,
    per_language: int = 800, width: int = 1 << 14, order: int = 3, landmarks: int = 240, languages: int = 200,
) -> KernelModel:
    """Fit on rows whose crc32(id as text) mod folds is not `held` and whose lang and text aren't null: of each language the
    `per_language` rows with the least hashes of id, text and language (all, if fewer), equal rows counted once. Of more than
    `languages` languages the most frequent are learnt, of equally frequent ones the first in order; `landmarks` should be no fewer."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, folds) != held))
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text, lang)
    rows = rows.select(lang.alias("lang"), h.alias("h"), text.alias("t"))
    with Scratch(docs.sparkSession, "langs") as scratch:
        each = scratch.write(rows.groupBy("lang", "h").agg(F.count("*").alias("n")), "rows")
        learnt = each.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
        least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        some = each.join(F.broadcast(learnt), "lang").withColumn("r", least).filter(F.col("r") <= per_language)
        cuts = scratch.write(some.groupBy("lang").agg(F.max("h").alias("cut")), "cuts")
        chosen = rows.join(F.broadcast(cuts), "lang").filter(F.col("h") <= F.col("cut")).select("lang", "h", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first in range(0, b.num_rows, 256):
                    part = b.slice(first, 256)
                    bits = np.packbits(grams(part.column(2).to_pylist(), width, order), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in bits], pa.binary())], names=["lang", "h", "bits"])

        # At most languages * per_language rows of width / 8 bytes come to the driver.
        got = map_texts(chosen, run, "lang string, h long, bits binary").dropDuplicates(["lang", "h"]).toPandas()
    got = got.sort_values(["h", "lang", "bits"], ignore_index=True)
    present = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(-1, width // 8), axis=1)
    return fit(present, got["lang"].to_numpy(dtype=object), order, landmarks)


def predict(docs: DataFrame, model: KernelModel, id_col: str = "doc_id", text_col: str = "text", batch: int = 128) -> DataFrame:
    """(id, lang_pred, score) for each row: the language with the largest decision value, and that value from -1..1 moved
    to 0..1. und, with score 0, where the text is null or has no letter, or nothing was learnt."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], dtype=object)
        for b in batches:
            texts = b.column(1).to_pylist()
            pick, best = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if model.languages:
                for first in range(0, len(texts), batch):
                    part = texts[first : first + batch]
                    values = model.decide(grams(part, len(model.weights), model.order))
                    pick[first : first + batch] = values.argmax(axis=1)
                    best[first : first + batch] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
                for i, t in enumerate(texts):
                    if not any(map(str.isalpha, t)):
                        pick[i], best[i] = len(model.languages), 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pick], pa.string()), pa.array(best)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return map_texts(rows, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1,
    **options,
) -> DataFrame:
    """Per row of docs: id, held_out, lang_pred and score; learnt from the rows that are not held out. Repeated rows are kept;
    an empty table gives an empty result; whatever the lang or other columns of a row hold, they don't enter its prediction.
    Null texts and those without a letter are und. A text of any length is read whole, in one task. Of languages with equal scores the first by
    name is taken. Names of other columns don't matter."""
    model = train(docs, id_col, text_col, lang_col, folds, held, **options)
    return predict(docs, model, id_col, text_col).select(id_col, (crc_mod(id_col, folds) == held).alias("held_out"), "lang_pred", "score")
