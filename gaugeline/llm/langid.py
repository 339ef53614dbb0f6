"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (letters lower-cased, everything else a blank), weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means over all of its texts. A text takes the language
of the centroid with the largest cosine, and is rejected where that cosine is far below what training texts of its length
reach. The training texts' counts are stored once; each round reads them and sends one sum a centroid and task on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._split import bucket
from gaugeline.llm._store import Scratch
from gaugeline.llm._sums import added, packed, summed, total, unpacked, weights
from gaugeline.llm._text import chunks

DIM = 4096
#: Centroids for each language, and rounds of k-means at most.
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below REJECT times the cosine that all but LOWEST of the training texts and pieces of its length reach.
REJECT, LOWEST = 0.6, 0.01
#: Lengths are told apart by powers of two. Each training text counts in its own class and gives one piece to every
#: class from PIECES on below it; a class of fewer than ENOUGH takes the limit of the next shorter one.
LENGTHS, PIECES, ENOUGH = 24, 4, 50
#: Cosines are counted in steps of 1 / STEPS to find that limit.
STEPS = 1 << 13
#: Documents whose counts are dense at a time.
DENSE = 512

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n-gram counts (documents x DIM, float32) of byte bigrams and trigrams."""
    n = len(at) - 1
    out = np.zeros((n, DIM), dtype=np.float32)
    if len(data) < 3:
        return out
    x = _FOLD[data]
    # capital accented Latin letters: their second UTF-8 byte is 0x20 below the small one's
    upper = np.zeros(len(x), dtype=bool)
    upper[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
    x = np.where(upper, x | 0x20, x).astype(np.uint32)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(20)
    pair = ((x[:-2] << 8 | x[1:-1]) * np.uint32(0x85EBCA77)) >> np.uint32(20)
    blank = (x[:-2] == 32) & (x[1:-1] == 32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))[: len(code)]
    # an n-gram that starts in a document's last two bytes would reach into the next one
    inside = np.arange(len(code)) + 2 < at[1:][doc]
    keep = inside & ~blank
    cell = doc[keep] * DIM
    flat = np.bincount(np.concatenate([cell + code[keep], cell + pair[keep]]), minlength=n * DIM)
    return flat.reshape(n, DIM).astype(np.float32)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _length(n_bytes: np.ndarray) -> np.ndarray:
    """The class of each length."""
    return np.minimum(np.frexp(n_bytes.astype(np.float64))[1], LENGTHS - 1)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text, and a piece from its middle for each shorter class of lengths, in whole characters."""
    yield raw
    for k in range(PIECES, min(LENGTHS, int(_length(np.array([len(raw)]))[0]))):
        size = 3 << (k - 2)
        a = (len(raw) - size) // 2
        yield raw[a : a + size].decode("utf-8", "ignore").encode()


def _limits(reached: dict[int, np.ndarray]) -> np.ndarray:
    """The least accepted cosine of each length class, from counts by step; shorter texts are never asked for more than longer ones."""
    out = np.zeros(LENGTHS)
    for k in range(1, LENGTHS):
        below = np.cumsum(reached.get(k, np.zeros(STEPS + 1, np.int64)))
        low = int(np.searchsorted(below, LOWEST * (below[-1] - 1), side="right")) / STEPS
        out[k] = max(out[k - 1], REJECT * low) if below[-1] >= ENOUGH else out[k - 1]
    return out


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    have = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = have[at[1:]] > have[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class LanguageModel:
    """idf weights, unit centroids, the language of each centroid and each length's least accepted cosine."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def _vectors(rows: DataFrame) -> DataFrame:
    """(h, lang, cells, counts) of every text with a letter and an n-gram; rows: (h, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(2), most=DENSE):
                counts = _counts(data, at)
                counts[~_letters(data, at)] = 0
                flat = counts.reshape(-1)
                place = np.flatnonzero(flat)
                by = np.searchsorted(place, np.arange(hi - lo + 1) * DIM)
                have = pa.array(np.diff(by) > 0)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *packed(place % DIM, flat[place], by)]
                yield pa.RecordBatch.from_arrays([x.filter(have) for x in columns], ["h", "lang", "cells", "counts"])

    return rows.mapInArrow(run, "h long, lang string, cells binary, counts binary")


def _first(vectors: DataFrame, centroids: int) -> list:
    """The ``centroids`` different texts of each language with the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(1).dictionary_encode().indices.to_numpy()
            h = batch.column(0).to_numpy()
            order = np.lexsort((h, code))
            code, h = code[order], h[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (h[1:] != h[:-1])])[: len(order)]
            order, code = order[new], code[new]
            place = np.arange(len(code)) - np.searchsorted(code, code)
            yield batch.take(pa.array(order[place < centroids]))

    best = vectors.mapInArrow(run, vectors.schema).dropDuplicates(["lang", "h"])
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= centroids)
    return sorted(best.collect(), key=lambda r: (r["lang"], r["place"]))


def fit(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", centroids: int = CENTROIDS) -> LanguageModel | None:
    """Learns every non-null language from all of its texts, each as often as it occurs; None if there are none.

    Sums are of whole numbers (``_sums``), so the model does not depend on partitions.
    """
    text = F.col(text_col).cast("string")
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(text, F.lit("langid")).alias("h"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    vectors = Scratch(texts.sparkSession, "langid").keep(_vectors(rows), "vectors")

    def frequencies(cell: np.ndarray, count: np.ndarray, by: np.ndarray, _) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(1, np.int64), np.bincount(cell, minlength=DIM)[None], np.array([len(by) - 1])

    counted = added(vectors, frequencies)
    if not counted:
        return None
    df, n = counted[0]
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.01
    first = _first(vectors, centroids)
    names = sorted({r["lang"] for r in first})
    # the j-th centroid of every language; some have fewer
    c = np.zeros((centroids, len(names), DIM))
    have = np.zeros((centroids, len(names)), dtype=bool)
    cell, count, by = unpacked(*(pa.array([bytes(r[k]) for r in first], pa.binary()) for k in ("cells", "counts")))
    x = weights(cell, count, by, idf)
    for r, a, b in zip(first, by[:-1], by[1:], strict=True):
        j, k = r["place"] - 1, names.index(r["lang"])
        c[j, k, cell[a:b]] = x[a:b]
        have[j, k] = True

    before: dict = {}
    for _ in range(ROUNDS):
        now = added(vectors, _nearest_sums(c, have, names, idf), "lang")
        for g, (vector, _n) in now.items():
            v = vector.astype(np.float64)
            c[g // len(names), g % len(names)] = v / max(float(np.sqrt((v * v).sum())), 1e-12)
        if now.keys() == before.keys() and all(np.array_equal(now[g][0], before[g][0]) for g in now):
            break
        before = now
    owner = [k for k in range(len(names)) for j in range(centroids) if have[j, k]]
    cents = np.stack([c[j, k] for k in range(len(names)) for j in range(centroids) if have[j, k]]).astype(np.float32)
    model = LanguageModel(names, idf, cents, np.array(owner), np.zeros(LENGTHS))

    def reach(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(0, batch.num_rows, DENSE // 8):
            parts = pa.array([p for text in batch.column(0).slice(i, DENSE // 8).to_pylist() for p in _pieces(text.encode())], pa.binary())
            for _, _, data, at in chunks(parts, most=DENSE):
                use = _letters(data, at)
                best = (_weighted(_counts(data, at), model.idf) @ model.centroids.T).max(axis=1)[use]
                step = (np.clip(best, 0, 1) * STEPS).astype(np.int64)
                size, own, rows = np.unique(_length(np.diff(at)[use]), return_inverse=True, return_counts=True)
                yield size, np.bincount(own * (STEPS + 1) + step, minlength=len(size) * (STEPS + 1)).reshape(-1, STEPS + 1), rows

    model.least = _limits({k: v for k, (v, _) in total(rows.select("text"), reach).items()})
    return model


def _nearest_sums(c: np.ndarray, have: np.ndarray, names: list[str], idf: np.ndarray):
    flat, known = c.reshape(len(c), -1).copy(), pa.array(names)

    def run(cell: np.ndarray, count: np.ndarray, by: np.ndarray, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = weights(cell, count, by, idf)
        k = pc.index_in(lang, value_set=known).to_numpy().astype(np.int64)
        at = np.repeat(k, np.diff(by)) * DIM + cell
        cos = np.stack([np.where(ok[k], np.add.reduceat(row[at] * x, by[:-1]), -1.0) for row, ok in zip(flat, have, strict=True)])
        return summed(cos.argmax(axis=0) * len(names) + k, cell, x, by, DIM)

    return run


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language, its cosine (0 to 1) and whether the text is rejected to every row.

    A null text, or one without a letter of any script, is ``und`` with score 0 and rejected; with no model all are.
    Texts are read whole, however long, DENSE documents at a time; repeated rows get values equal to single precision. All columns of
    ``docs`` but those of the given names, which are replaced, are kept.
    """
    docs = docs.drop(*names)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            for lo, hi, data, at in chunks(column.cast(pa.string()), most=DENSE):
                lang = np.full(hi - lo, "und", dtype=object)
                score, out = np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
                if model is not None:
                    letter = _letters(data, at)
                    cos = _weighted(_counts(data, at), model.idf) @ model.centroids.T
                    best = cos.argmax(axis=1)
                    owner = model.owner[best]
                    top = cos[np.arange(hi - lo), best].astype(np.float64)
                    lang[letter] = np.array(model.languages, dtype=object)[owner[letter]]
                    score[letter] = np.clip(top, 0, 1)[letter]
                    out = ~letter | (top < model.least[_length(np.diff(at))])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def learned_rows(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32(id as text) mod 4 is not 2."""
    return F.coalesce(bucket(id_col, 4) != 2, F.lit(False))
