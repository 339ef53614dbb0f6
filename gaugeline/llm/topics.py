"""Topics of documents: clusters of hashed word vectors, learned from every text.

A text becomes a vector of its words of LEAST bytes and more (A-Z lower-cased, hashed into DIM cells), weighted by
TF-IDF and normalised; spherical k-means over all texts gives the topics, and every text takes that of the largest cosine.
The vectors' counts are stored once; each round reads them and sends one sum a topic and task on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._store import Scratch
from gaugeline.llm._sums import added, packed, summed, unpacked, weights
from gaugeline.llm._text import FOLDED, U64, chunks, mix64, prefix_hash, span_hash, words

DIM, LEAST = 2048, 4
#: Topics, and rounds of k-means at most.
TOPICS, ROUNDS = 12, 15
#: Texts that a pass over all brings to the driver as possible first centroids.
CANDIDATES = 256
#: Documents whose vectors are dense at a time.
DENSE = 1024
NONE = "none"


@dataclass
class TopicModel:
    idf: np.ndarray
    centroids: np.ndarray  # topics x DIM, unit vectors


def _cells(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of each counted word."""
    start, end, by = words(data, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(by))
    long = end - start >= LEAST
    code = span_hash(prefix_hash(FOLDED[data]), start[long], end[long])
    return doc[long], (code & U64(DIM - 1)).astype(np.int64)


def _counts(doc: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, counts, n + 1 offsets) of n documents."""
    dense = np.bincount(doc * DIM + cell, minlength=n * DIM)
    at = np.flatnonzero(dense)
    return at % DIM, dense[at], np.searchsorted(at, np.arange(n + 1) * DIM)


def _cosines(cell: np.ndarray, x: np.ndarray, by: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of every document, which all have cells, with every centroid; the same whatever documents stand beside it."""
    return np.stack([np.add.reduceat(c[cell] * x, by[:-1]) for c in centroids], axis=1)


def _vectors(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, cells, counts) of every text that has a counted word; h is a hash of the text."""
    text = F.col(text_col).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1), most=DENSE):
                cell, count, by = _counts(*_cells(data, at), hi - lo)
                have = pa.array(np.diff(by) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(have), *(x.filter(have) for x in packed(cell, count, by))], ["h", "cells", "counts"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text, F.lit("topics")).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "h long, cells binary, counts binary")


def learn(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> TopicModel | None:
    """Learns from every text, each as often as it occurs; None where none has a counted word.

    Sums are of whole numbers (``_sums``), so the model does not depend on partitions.
    """
    vectors = Scratch(docs.sparkSession, "topics").keep(_vectors(docs, text_col), "vectors")

    def frequencies(cell: np.ndarray, count: np.ndarray, by: np.ndarray, _) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(1, np.int64), np.bincount(cell, minlength=DIM)[None], np.array([len(by) - 1])

    total = added(vectors, frequencies)
    if not total:
        return None
    df, n = total[0]
    idf = (np.log((1 + n) / (1 + df)) + 0.01).astype(np.float32)

    c = _first(vectors, idf, topics)
    before = None
    for _ in range(ROUNDS):
        now = added(vectors, _nearest_sums(c, idf))
        for k, (vector, _) in now.items():
            x = vector.astype(np.float64)
            c[k] = x / max(float(np.sqrt((x * x).sum())), 1e-12)
        if before is not None and all(np.array_equal(now[k][0], before.get(k, (None,))[0]) for k in now):
            break
        before = now
    return TopicModel(idf, c)


def _first(vectors: DataFrame, idf: np.ndarray, topics: int) -> np.ndarray:
    """First centroids: texts drawn by their hashes, each next one more likely the less it is like those so far (k-means++).

    A text's place is -log(u) / (1 - its cosine with the nearest centroid); the smallest is next. Places only grow, so
    the next of a pass's CANDIDATES is next of all while its place is below the last candidate's.
    """

    def far(cell: np.ndarray, x: np.ndarray, by: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = 1 - _cosines(cell, x, by, c).max(axis=1) if len(c) else np.ones(len(by) - 1)
        return np.where(out < 1e-6, 0.0, out)

    def places(c: np.ndarray) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, count, by = unpacked(batch.column(1), batch.column(2))
                u = (mix64(batch.column(0).to_numpy().view(U64)) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
                away = far(cell, weights(cell, count, by, idf), by, c)
                place = np.full(len(u), np.inf)
                np.divide(-np.log(u), away, out=place, where=away > 0)
                best = np.lexsort((batch.column(0).to_numpy(), place))[:CANDIDATES]
                best = pa.array(best[np.isfinite(place[best])])
                yield pa.RecordBatch.from_arrays([pa.array(-np.log(u)).take(best), pa.array(place).take(best), *(x.take(best) for x in batch.columns)], ["draw", "place", "h", "cells", "counts"])

        out = vectors.mapInArrow(run, "draw double, place double, h long, cells binary, counts binary")
        return out.orderBy("place", "h", "cells", "counts").limit(CANDIDATES).collect()

    c = np.zeros((0, DIM))
    while len(c) < topics and (got := places(c)):
        cell, count, by = unpacked(*(pa.array([bytes(r[k]) for r in got], pa.binary()) for k in ("cells", "counts")))
        x, draw = weights(cell, count, by, idf), np.array([r["draw"] for r in got])
        bound = got[-1]["place"] if len(got) == CANDIDATES else np.inf
        place = np.array([r["place"] for r in got])
        while len(c) < topics and np.isfinite(place.min()) and (place.min() < bound or place.min() == got[0]["place"]):
            i = int(place.argmin())
            c = np.concatenate([c, np.zeros((1, DIM))])
            c[-1, cell[by[i] : by[i + 1]]] = x[by[i] : by[i + 1]]
            away = far(cell, x, by, c)
            place = np.full(len(draw), np.inf)
            np.divide(draw, away, out=place, where=away > 0)
    return c


def _nearest_sums(c: np.ndarray, idf: np.ndarray):
    c = c.copy()

    def run(cell: np.ndarray, count: np.ndarray, by: np.ndarray, _) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = weights(cell, count, by, idf)
        own = _cosines(cell, x, by, c).argmax(axis=1)
        return summed(own, cell, x, by, DIM)

    return run


def assign(docs: DataFrame, model: TopicModel | None, text_col: str = "text", name: str = "topic", tokens: str | None = None) -> DataFrame:
    """Adds the topic (``topic_00``, ...) of every whole text; NONE for a null text, one without counted words, or no model.

    tokens: a column for the number of words ``[^\\x20\\x09-\\x0D]+``, too. Columns of these names are replaced.
    """
    docs = docs.drop(name, *([tokens] if tokens else []))
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), *([T.StructField(tokens, T.LongType())] if tokens else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(place).cast(pa.string()), most=DENSE):
                label = np.full(hi - lo, NONE, dtype=object)
                if model is not None:
                    cell, count, by = _counts(*_cells(data, at), hi - lo)
                    have = np.flatnonzero(np.diff(by))
                    if len(have):
                        by = np.append(by[have], len(cell))
                        best = _cosines(cell, weights(cell, count, by, model.idf), by, model.centroids).argmax(axis=1)
                        label[have] = [f"topic_{k:02d}" for k in best]
                extra = [pa.array(np.diff(words(data, at)[2]))] if tokens else []
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(label, pa.string()), *extra], schema.names)

    return docs.mapInArrow(run, schema)
