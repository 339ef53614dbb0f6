"""Quality score: a byte-level convolutional network in numpy.

Each byte becomes a symbol, byte + 256 where its four bytes also stand a few bytes back. Learned filters of WIDTH
symbols run over the whole text every STRIDE bytes. Their activations are max-pooled over overlapping chunks; the
largest and the mean over chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._split import sample_every
from gaugeline.llm._store import Scratch
from gaugeline.llm._text import chunks

WIDTH, STRIDE, DEPTH, FILTERS = 12, 4, 8, 32
#: Windows in a chunk, and from one chunk's start to the next.
CHUNK_WINDOWS, HOP_WINDOWS = 512, 448
#: Labelled rows to learn from: about EACH of either label. Passes over them, documents in a step.
EACH, EPOCHS, STEP = 1000, 10, 16
#: Bytes of the sample's texts: where they have more, the sample is thinned evenly, whatever the texts' lengths.
SAMPLE_BYTES = 16 << 20
_LAGS = range(3, 25)


@dataclass
class QualityNet:
    table: np.ndarray  # 512 symbols x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    shift: float  # from the sample's balance to the labels' own


def _symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols of a chunk of texts; a repeat counts within a text only."""
    n = len(data)
    sym = data.astype(np.int16)
    if n < 8:
        return sym
    four = data[3:].astype(np.uint32) << 24 | data[2:-1].astype(np.uint32) << 16 | data[1:-2].astype(np.uint32) << 8 | data[:-3]
    hit = np.zeros(n, dtype=bool)
    for lag in _LAGS:
        if lag < len(four):
            hit[3 + lag :] |= four[lag:] == four[:-lag]
    # not across the start of a text
    for k in range(_LAGS[-1] + 3):
        p = at[:-1] + k
        hit[p[p < at[1:]]] = False
    sym[hit] += 256
    return sym


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, the end of its text, and n + 1 offsets by text; the last window of a text ends with it."""
    size = np.diff(at)
    count = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
    by = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(by[-1]) - np.repeat(by[:-1], count)
    start = np.minimum(k * STRIDE, np.repeat(np.maximum(size - WIDTH, 0), count))
    return start + np.repeat(at[:-1], count), np.repeat(at[1:], count), by


def _spans(by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 window of each chunk, and n + 1 offsets into the chunks by text."""
    count = np.diff(by)
    pieces = np.maximum(1, -(-(count - CHUNK_WINDOWS) // HOP_WINDOWS) + 1)
    off = np.concatenate([[0], np.cumsum(pieces)])
    k = np.arange(off[-1]) - np.repeat(off[:-1], pieces)
    lo = np.repeat(by[:-1], pieces) + k * HOP_WINDOWS
    return lo, np.minimum(lo + CHUNK_WINDOWS, np.repeat(by[1:], pieces)), off


def _activate(net: QualityNet, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([sym, np.zeros(WIDTH, np.int16)])
    rows = padded[start[:, None] + np.arange(WIDTH)]
    # what follows a short text in the chunk is not its own
    short = np.flatnonzero(end - start < WIDTH)
    if len(short):
        rows[short] = np.where(start[short, None] + np.arange(WIDTH) < end[short, None], rows[short], 0)
    return np.maximum(net.table[rows].reshape(len(start), -1) @ net.filters + net.bias, 0), rows


def _pooled(act: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi, off = _spans(by)
    act = np.concatenate([act, np.zeros((1, act.shape[1]), act.dtype)])
    each = np.maximum.reduceat(act, np.stack([lo, hi], axis=1).reshape(-1), axis=0)[::2]
    return each, np.maximum.reduceat(each, off[:-1], axis=0), np.add.reduceat(each, off[:-1], axis=0) / np.diff(off)[:, None]


def score_chunk(net: QualityNet, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    start, end, by = _windows(at)
    sym = _symbols(data, at)
    act = np.empty((len(start), FILTERS), dtype=np.float32)
    for i in range(0, len(start), 1 << 14):
        act[i : i + (1 << 14)] = _activate(net, sym, start[i : i + (1 << 14)], end[i : i + (1 << 14)])[0]
    _, top, mean = _pooled(act, by)
    z = np.concatenate([top, mean], axis=1) @ net.out + net.out_bias + net.shift
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _train(texts: list[bytes], label: np.ndarray, epochs: int) -> QualityNet:
    rng = np.random.default_rng(5)
    f32 = np.float32
    net = QualityNet(rng.normal(0, 0.5, (512, DEPTH)).astype(f32), rng.normal(0, 0.15, (WIDTH * DEPTH, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.1, 2 * FILTERS).astype(f32), 0.0, 0.0)
    slots = ("table", "filters", "bias", "out", "out_bias")
    m, v = {s: np.zeros_like(getattr(net, s), dtype=f32) for s in slots}, {s: np.zeros_like(getattr(net, s), dtype=f32) for s in slots}
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(texts))
        for b in range(0, len(order), STEP):
            own = order[b : b + STEP]
            data = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
            at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]).astype(np.int64)
            start, end, by = _windows(at)
            act, rows = _activate(net, _symbols(data, at), start, end)
            each, top, mean = _pooled(act, by)
            lo, hi, off = _spans(by)
            feat = np.concatenate([top, mean], axis=1)
            p = 1 / (1 + np.exp(-np.clip(feat @ net.out + net.out_bias, -30, 30)))
            dz = ((p - label[own]) / len(own)).astype(f32)
            grad = {"out": feat.T @ dz + f32(1e-4) * net.out, "out_bias": dz.sum()}
            # only the window that gave a chunk's maximum learns from it
            doc = np.repeat(np.arange(len(own)), np.diff(off))
            share = dz[doc, None] * (net.out[:FILTERS] * (each >= top[doc]) + net.out[FILTERS:] / np.diff(off)[doc, None])
            share = np.where(each > 0, share, 0).astype(f32)
            win = np.stack([act[i:j].argmax(axis=0) + i for i, j in zip(lo, hi, strict=True)])
            flat, chan = win.reshape(-1), np.tile(np.arange(FILTERS), len(lo))
            g = share.reshape(-1)
            use = g != 0
            flat, chan, g = flat[use], chan[use], g[use]
            x = net.table[rows[flat]].reshape(len(flat), -1)
            gf = np.zeros((FILTERS, WIDTH * DEPTH), dtype=f32)
            np.add.at(gf, chan, x * g[:, None])
            back = (net.filters.T[chan] * g[:, None]).reshape(-1, DEPTH)
            gt = np.zeros_like(net.table)
            np.add.at(gt, rows[flat].reshape(-1), back)
            grad |= {"filters": gf.T, "bias": np.bincount(chan, weights=g, minlength=FILTERS).astype(f32), "table": gt}
            t += 1
            for s in slots:
                m[s] = 0.9 * m[s] + 0.1 * grad[s]
                v[s] = 0.999 * v[s] + 0.001 * grad[s] ** 2
                setattr(net, s, (getattr(net, s) - rate * (m[s] / (1 - 0.9**t)) / (np.sqrt(v[s] / (1 - 0.999**t)) + 1e-8)).astype(f32))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = EACH, epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES) -> QualityNet | None:
    """Learns from about ``each`` rows of either label, of about ``sample_bytes`` in all; None where a label has no rows.

    The sample is drawn from the labels, so only its texts leave the scan; texts are read whole, however long. A sample
    of more bytes is thinned by a hash that does not depend on the texts, so long ones are as likely as short ones. A
    document with several label rows counts with each.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").cast("string").alias("label"))
    counts = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    sample = sample_every(known, "label", "id", None, each, 2 * each, each)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = Scratch(docs.sparkSession, "quality").keep(rows, "sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    place = F.pmod(F.xxhash64("id", F.lit("thin")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = rows.where(place < F.lit(sample_bytes / max(1, size))).select(F.col("label").cast("int").alias("label"), "text").orderBy(F.xxhash64("id"), "id", "label").toArrow()
    label = rows["label"].to_numpy().astype(np.float32)
    if not label.size or label.min() == label.max():
        return None
    net = _train([(x or "").encode() for x in rows["text"].to_pylist()], label, epochs)
    net.shift = float(np.log(counts[1] / counts[0]) - np.log(label.sum() / (len(label) - label.sum())))
    return net


def score(docs: DataFrame, net: QualityNet | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row; a null text counts as empty; without a net every row gets 0.5.

    Texts are read whole, however long; repeated rows get values equal to single precision. A column of the given name is replaced.
    """
    docs = docs.drop(name)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(place).cast(pa.string())):
                p = np.full(hi - lo, 0.5) if net is None else score_chunk(net, data, at)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
