"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A text's words are compared without case and punctuation. For every length that items have, all windows of so many words
are candidates; a window goes on where shingles of the benchmark make up SIMILARITY of its weight, since no item can be
that similar otherwise. Such a window gets a fingerprint of its weighted shingles and meets the items of its length: their
fingerprints are split into RADIUS + 1 blocks, two within RADIUS agree in one block at least, so the blocks' tables give
all items within RADIUS. These are verified by the weighted Jaccard similarity of the shingle multisets. A shingle weighs
its words' bytes, so a match depends on the window and the item alone, however large the benchmark is.

A fingerprint's bits follow the angle between two weight vectors. So that this is the similarity's, however uneven the
weights are, a shingle enters as many parts of UNIT bytes, each with signs of its own, and so does every further occurrence
of it. At similarity s the angle is then arccos(2 s / (1 + s)) at most, up to the rounding of weights to whole units.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._names import fresh
from gaugeline.llm._store import Scratch
from gaugeline.llm._text import BYTE_HASH, U64, chunks, mix64, prefix_hash, span_hash, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint and the radius: similarity 0.8 leaves 38.8 of 256 bits different, with a deviation of 5.7, so a
#: pair at the threshold lies beyond the radius with a probability of about 2e-5, and more alike ones with less.
BITS, RADIUS = 256, 63
#: Bytes of a part of a shingle.
UNIT = 4
#: Bytes of benchmark text in one index. Of a larger benchmark, documents with none of its shingles are settled in one
#: pass, and the others are searched in several.
INDEX_BYTES = 4 << 20
#: Bits of the filter of a larger benchmark's shingles.
FILTER_BITS = 1 << 26
#: Shingles whose signs are summed at a time.
SPAN = 8192

#: Letters and digits stay, capitals become small, other ASCII becomes a blank.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of each word, and n + 1 offsets by text."""
    x = _FOLD[data]
    if len(x) > 1:
        upper = np.zeros(len(x), dtype=bool)
        upper[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x = np.where(upper, x | 0x20, x)
    start, end, by = words(x, at)
    return span_hash(prefix_hash(BYTE_HASH[x]), start, end), end - start, by


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    h = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix64(h * U64(0x9FB21C651E98DF25) + hashes[k : k + n] + U64(size))
    return h


def _weights(size: np.ndarray, run: int) -> np.ndarray:
    """Bytes of the words of each run of ``run`` words."""
    total = np.concatenate([[0], np.cumsum(size)])
    return total[run:] - total[: max(0, len(total) - run)]


def _signs(parts: np.ndarray) -> np.ndarray:
    """BITS signs of each part."""
    with np.errstate(over="ignore"):
        h = mix64(parts[:, None] + U64(0x9E3779B97F4A7C15) * np.arange(1, BITS // 64 + 1, dtype=U64))
    return np.unpackbits(h.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _vectors(shingles: np.ndarray, weight: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The sum of the signs of each shingle's parts, one for UNIT bytes (one at least); turn: which occurrence of it this is."""
    out = np.zeros((len(shingles), BITS), dtype=np.int32)
    parts = np.maximum(1, (weight + UNIT // 2) // UNIT)
    stop = np.cumsum(parts)
    for a in range(0, int(stop[-1]) if len(stop) else 0, SPAN):
        b = min(a + SPAN, int(stop[-1]))
        own = np.searchsorted(stop, np.arange(a, b), side="right")
        part = np.arange(a, b) - (stop - parts)[own]
        with np.errstate(over="ignore"):
            seed = mix64(shingles[own] + U64(0x9FB21C651E98DF25) * (turn[own].astype(U64) + U64(1))) + mix64(part.astype(U64) + U64(1))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(_signs(seed), first, axis=0, dtype=np.int32)
    return out


def _turns(shingles: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it."""
    order = np.argsort(shingles, kind="stable")
    new = np.flatnonzero(np.diff(shingles[order], prepend=shingles[order][:1] + U64(1)))
    out = np.empty(len(shingles), np.int64)
    out[order] = np.arange(len(shingles)) - np.repeat(new, np.diff(new, append=len(shingles)))
    return out


def _code(shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fingerprint of a multiset of shingles."""
    return np.packbits(_vectors(shingles, weight, _turns(shingles)).sum(axis=0) > 0)


def _blocks(codes: np.ndarray) -> np.ndarray:
    """The RADIUS + 1 block values of each code."""
    bits = np.unpackbits(codes, axis=1)
    width = BITS // (RADIUS + 1)
    return bits.reshape(len(codes), RADIUS + 1, width) @ (1 << np.arange(width))


def jaccard(a: Counter, b: Counter, weight_a: dict[int, int], weight_b: dict[int, int]) -> float:
    low = high = 0
    for s in a.keys() | b.keys():
        w = weight_a[s] if s in weight_a else weight_b[s]
        low += w * min(a[s], b[s])
        high += w * max(a[s], b[s])
    return low / high if high else 0.0


class _Items:
    """The items of one length: fingerprints, and for each block and value the items that have it there."""

    def __init__(self, length: int, size: int):
        self.length, self.size = length, size
        self.number: list[int] = []

    def close(self, codes: np.ndarray, total: np.ndarray) -> None:
        self.codes, self.least = codes[self.number], int(total[self.number].min())
        value = _blocks(self.codes)
        self.tables = np.zeros((RADIUS + 1, 1 << (BITS // (RADIUS + 1)), len(self.number)), dtype=bool)
        for i in range(len(self.number)):
            self.tables[np.arange(RADIUS + 1), value[i], i] = True

    def within(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, place of the item) of every pair within RADIUS."""
        rows, places = [], []
        step = max(1, (1 << 22) // max(1, len(self.number)))
        for i in range(0, len(codes), step):
            part = codes[i : i + step]
            value = _blocks(part)
            maybe = np.zeros((len(part), len(self.number)), dtype=bool)
            for j in range(RADIUS + 1):
                maybe |= self.tables[j, value[:, j]]
            r, k = np.nonzero(maybe)
            near = np.bitwise_count(part[r] ^ self.codes[k]).sum(axis=1) <= RADIUS
            rows.append(r[near] + i)
            places.append(k[near])
        return np.concatenate(rows), np.concatenate(places)


class BenchmarkIndex:
    """Items with distinct word sequences, their shingles and fingerprints, and block tables by item length."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = SHINGLE, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids: list[list[int | None]] = []
        self.bags: list[Counter] = []
        self.weight: dict[int, int] = {}
        known: dict[bytes, int] = {}
        keys: dict[int, set[int]] = defaultdict(set)
        codes, total = [], []
        groups: dict[tuple[int, int], _Items] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            h, n_bytes, _ = _word_hashes(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            if h.tobytes() in known:
                self.ids[known[h.tobytes()]].append(item)
                continue
            i = known[h.tobytes()] = len(self.ids)
            size = min(shingle, len(h))
            run, w = _runs(h, size), _weights(n_bytes, size)
            self.ids.append([item])
            self.bags.append(Counter(run.tolist()))
            self.weight.update(zip(run.tolist(), w.tolist(), strict=True))
            keys[size].update(run.tolist())
            codes.append(_code(run, w))
            total.append(int(w.sum()))
            groups.setdefault((len(h), size), _Items(len(h), size)).number.append(i)
        self.codes = np.stack(codes) if codes else np.zeros((0, BITS // 8), np.uint8)
        self.groups = [groups[k] for k in sorted(groups)]
        for g in self.groups:
            g.close(self.codes, np.array(total))
        self.keys = {size: np.array(sorted(k), dtype=U64) for size, k in sorted(keys.items())}
        self.filter = np.zeros(1 << 20, dtype=bool)
        for k in self.keys.values():
            self.filter[(k & U64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, run: dict[int, np.ndarray], weight: dict[int, np.ndarray], known: dict[int, np.ndarray], n_words: int) -> list[tuple[int | None, int, float]]:
        """(item, first word, similarity) for the best window of each item in one document, and the items equal to it."""
        least = self.similarity - 1e-9
        best: dict[int, tuple[float, int]] = {}
        for size, r in run.items():
            all_w = np.concatenate([[0], np.cumsum(weight[size])])
            known_w = np.concatenate([[0], np.cumsum(np.where(known[size], weight[size], 0))])
            starts, stops, owner = [], [], []
            for g, group in enumerate(self.groups):
                if group.size != size:
                    continue
                n = min(group.length, n_words) - size + 1
                have, of = known_w[n:] - known_w[:-n], all_w[n:] - all_w[:-n]
                at = np.flatnonzero((have >= least * of) & (have >= least * group.least))
                starts.append(at)
                stops.append(at + n)
                owner.append(np.full(len(at), g))
            start, stop, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops, owner))
            order = np.argsort(start, kind="stable")
            start, stop, own = start[order], stop[order], own[order]
            i = 0
            while i < len(start):
                j = int(np.searchsorted(start, start[i] + SPAN))
                lo, hi = start[i], stop[i:j].max()
                total = np.zeros((hi - lo + 1, BITS), dtype=np.int64)
                # one vector for each distinct shingle
                some, at, which = np.unique(r[lo:hi], return_index=True, return_inverse=True)
                np.cumsum(_vectors(some, weight[size][lo:hi][at], np.zeros(len(some), np.int64))[which], axis=0, out=total[1:])
                # windows that hold a shingle twice are summed by themselves
                order = np.argsort(which, kind="stable")
                before = np.full(hi - lo, -1)
                before[order[1:]] = np.where(which[order[1:]] == which[order[:-1]], order[:-1], -1)
                latest = np.maximum.accumulate(before)
                for g in np.unique(own[i:j]):
                    pick = i + np.flatnonzero(own[i:j] == g)
                    codes = np.packbits(total[stop[pick] - lo] - total[start[pick] - lo] > 0, axis=1)
                    # the latest repeated place is inside only if the shingle before it is
                    for w in np.flatnonzero(latest[stop[pick] - 1 - lo] >= start[pick] - lo).tolist():
                        a, b = start[pick[w]], stop[pick[w]]
                        codes[w] = _code(r[a:b], weight[size][a:b])
                    group, bags = self.groups[g], {}
                    for w, k in zip(*(x.tolist() for x in group.within(codes)), strict=True):
                        a, b = int(start[pick[w]]), int(stop[pick[w]])
                        if w not in bags:
                            bags[w] = Counter(r[a:b].tolist()), dict(zip(r[a:b].tolist(), weight[size][a:b].tolist(), strict=True))
                        bag, own_w = bags[w]
                        item = group.number[k]
                        sim = jaccard(bag, self.bags[item], own_w, self.weight)
                        if sim >= least and (item not in best or (sim, -a) > (best[item][0], -best[item][1])):
                            best[item] = (sim, a)
                i = j
        return [(item, start, sim) for i, (sim, start) in best.items() for item in self.ids[i]]

    def scan(self, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int | None, int, float]]]:
        """The matches of each document of a chunk."""
        hashes, n_bytes, by = _word_hashes(data, at)
        out: list = [[] for _ in range(len(at) - 1)]
        runs, weights, hits, docs = {}, {}, {}, {}
        for size, keys in self.keys.items():
            run = _runs(hashes, size)
            maybe = np.flatnonzero(self.filter[(run & U64((1 << 20) - 1)).astype(np.int64)])
            hit = np.zeros(len(run), dtype=bool)
            hit[maybe] = np.isin(run[maybe], keys)
            runs[size], weights[size], hits[size] = run, _weights(n_bytes, size), hit
            at_hit = np.flatnonzero(hit)
            doc = np.searchsorted(by, at_hit, side="right") - 1
            docs[size] = set(doc[at_hit + size <= by[doc + 1]].tolist())
        for d in sorted(set().union(*docs.values()) if docs else ()):
            a = by[d]
            own = {size: slice(a, by[d + 1] - size + 1) for size in docs if d in docs[size]}
            out[d] = self.matches(*({size: x[size][cut] for size, cut in own.items()} for x in (runs, weights, hits)), n_words=int(by[d + 1] - a))
        return out


def _filter(benchmark: DataFrame, text: str, shingle: int, bits: int) -> np.ndarray:
    """A bit for every shingle of the benchmark, by its hash; tasks send compressed bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, dtype=bool)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                hashes, _, by = _word_hashes(data, at)
                for a, b in zip(by[:-1], by[1:], strict=True):
                    if b > a:
                        have[(_runs(hashes[a:b], min(shingle, b - a)) & U64(bits - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(have).tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(bits, dtype=bool)
    for r in benchmark.select(F.col(text).cast("string")).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.unpackbits(np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)).astype(bool)
    return out


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    index_bytes: int = INDEX_BYTES,
    name: str = "matches",
) -> DataFrame:
    """Adds ``matches`` (array of item, first word, similarity) to every row: the items that a window of it resembles.

    Words are runs of letters and digits (bytes from 128 count as letters, A-Z are lower-cased). An item of fewer than
    ``shingle`` words counts as one shingle; items without words match nothing, equal items all match. Each item is
    listed once, with its most similar window (of these the first), items in order and those without an id last. Null
    texts match nothing; an item without an id is matched like any other, with a null item. Repeated rows are matched
    one by one. Very long texts are searched whole, SPAN shingles at a time.

    A benchmark beyond ``index_bytes`` is indexed in blocks of about that size, so what is sent to the executors at a
    time is bounded. All documents are read once, against a filter of the whole benchmark's shingles; only those that
    hold one are written and searched block by block. The matches do not depend on the blocks. All other columns of
    ``docs`` are kept, a column of the given name is replaced.
    """
    docs = docs.drop(name)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // index_bytes))
    place, last = docs.columns.index(text_col), len(docs.columns)
    kind = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("word", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    item_type = pa.list_(pa.struct([("item", pa.int64()), ("word", pa.int64()), ("similarity", pa.float64())]))
    order = lambda m: (m["item"] is None, m["item"] or 0, m["word"], m["similarity"])

    def search(rows: DataFrame, block: int) -> DataFrame:
        own = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block)
        items = [(None if r[0] is None else int(r[0]), r[1]) for r in own.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).collect()]
        index = spark.sparkContext.broadcast(BenchmarkIndex(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), shingle, similarity))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, at in chunks(batch.column(place).cast(pa.string())):
                    part = batch.slice(lo, hi - lo)
                    found = [[{"item": i, "word": w, "similarity": s} for i, w, s in m] for m in index.value.scan(data, at)]
                    if block:
                        found = [x + y for x, y in zip(part.column(last).to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array([sorted(m, key=order) for m in found], item_type)], schema.names)

        return rows.mapInArrow(run, schema)

    if blocks == 1:
        return search(docs, 0)

    scratch = Scratch(spark, "decontaminate")
    seen = spark.sparkContext.broadcast(_filter(benchmark, item_text, shingle, FILTER_BITS))
    (flag,) = fresh(docs, "maybe")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(place).cast(pa.string())):
                hashes, _, by = _word_hashes(data, at)
                hit = np.zeros(hi - lo, dtype=bool)
                for k in range(1, shingle + 1):
                    where = np.flatnonzero(seen.value[(_runs(hashes, k) & U64(FILTER_BITS - 1)).astype(np.int64)])
                    doc = np.searchsorted(by, where, side="right") - 1
                    hit[doc[where + k <= by[doc + 1]]] = True
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hit)], [*schema.names[:last], flag])

    marked = scratch.keep(docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])), "marked")
    found = marked.where(flag).drop(flag)
    for b in range(blocks):
        found = scratch.keep(search(found, b), f"pass-{b}")
        if b:
            scratch.drop(f"pass-{b - 1}")
    rest = marked.where(~F.col(flag)).drop(flag)
    return found.unionByName(rest.withColumn(name, F.array().cast(kind)))
