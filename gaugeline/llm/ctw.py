"""Language-model scores by context-tree weighting over bytes, beside a smoothed word-unigram base.

Every byte is decomposed into eight binary decisions; decision node pi (a prefix of the byte's bits) has a context tree
of its own over the DEPTH bytes before. A node at depth d < DEPTH weighs its Krichevsky-Trofimov estimate and the
product of its children half and half; learned counts give each depth's posterior weight, and a prediction
mixes the estimates of all depths. A context that was never seen predicts 1/2, as in the sequential algorithm.

A text is coded as its bytes, with zero bytes before it, and the byte 0xFF (never in UTF-8) to close it.

Scale: all that is gathered are counts of (context, byte) strings and of words, reduced in each task before the
shuffle. The model is built in partitions by the three nearest context bytes, a block of contexts at a time; only the nodes of depth 2 (65 536 x 255
at most) reach the driver. The commonest strings and words, at most HELD and HELD_WORDS, are broadcast; occurrences of
all others are joined with the whole table. The blocks below set a worker's memory and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm._store import Scratch, partitions
from gaugeline.llm._text import U64, chunks, word_hashes

DEPTH = 5
#: Entries of the broadcast tables at most: strings and words (about 20 bytes each).
HELD, HELD_WORDS = 2_000_000, 250_000
#: Bytes of texts that a task turns into strings at a time.
TEXT_BLOCK = 1 << 17
#: Strings that a task sorts at a time while it counts, and distinct ones that it holds before it hands them on.
COUNT_BLOCK, COUNT_HELD = 1_000_000, 1_000_000
#: Strings whose deeper levels a task builds at a time.
BUILD_BLOCK = 60_000
#: Depths up to NEAR are finished on the driver: at most 256**2 contexts of 255 nodes at depth 2, far fewer in text.
NEAR = 2
GRAM, WORD = 0, 1


def gram_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of (nearest context byte, ..., farthest, byte) for each byte and for the close of each text; n + 1 offsets."""
    n = len(at) - 1
    size = np.diff(at)
    buf = np.zeros(len(data) + (DEPTH + 1) * n, dtype=U64)
    by = at + np.arange(n + 1)
    place = np.arange(len(data)) + np.repeat((DEPTH + 1) * np.arange(n) + DEPTH, size)
    close = at[1:] + (DEPTH + 1) * np.arange(n) + DEPTH
    buf[place] = data
    buf[close] = 255
    where = np.empty(by[-1], dtype=np.int64)
    is_close = np.zeros(by[-1], dtype=bool)
    is_close[by[1:] - 1] = True
    where[is_close] = close
    where[~is_close] = place
    code = buf.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= buf[:-k] << U64(8 * (DEPTH + 1 - k))
    return code[where], by


def _reduced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[edge], np.diff(np.append(edge, len(x)))


def _with(held: tuple[np.ndarray, np.ndarray] | None, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts with further ones; held's counts may be overwritten."""
    if held is None:
        return code, n
    at = np.searchsorted(held[0], code)
    seen = held[0][np.minimum(at, len(held[0]) - 1)] == code
    held[1][at[seen]] += n[seen]
    at, code, n = at[~seen], code[~seen], n[~seen]
    return np.insert(held[0], at, code), np.insert(held[1], at, n)


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, code, n): each task's counts over training rows; strings that only other rows hold have n = 0."""

    def emit(kind: int, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(code), 1 << 16):
            c, k = code[i : i + (1 << 16)], n[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(c.view(np.int64)), pa.array(k.astype(np.int64))], ["kind", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list[np.ndarray]] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle() -> None:
            while waiting:
                (kind, learn), parts = waiting.popitem()
                x = np.concatenate(parts)
                parts.clear()
                code, n = _reduced(x)
                held[kind] = _with(held.get(kind), code, n if learn else np.zeros_like(n))

        for batch in batches:
            learn_col = batch.column(1).to_numpy(False)
            for lo, hi, data, at in chunks(batch.column(0), TEXT_BLOCK):
                learn = learn_col[lo:hi].astype(bool)
                code, by = gram_codes(data, at)
                mask = np.repeat(learn, np.diff(by))
                words, wby = word_hashes(data, at)
                for key, x in (((GRAM, True), code[mask]), ((GRAM, False), code[~mask]), ((WORD, True), words[np.repeat(learn, np.diff(wby))])):
                    if len(x):
                        waiting.setdefault(key, []).append(x)
                        size += len(x)
                if size >= COUNT_BLOCK:
                    settle()
                    size = 0
                    for kind in list(held):
                        if len(held[kind][0]) > COUNT_HELD:
                            yield from emit(kind, *held.pop(kind))
        settle()
        for kind in list(held):
            yield from emit(kind, *held.pop(kind))

    return docs.select("text", "learn").mapInArrow(run, "kind int, code long, n long")


_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (Lanczos)."""
    x = np.asarray(x, dtype=np.float64) - 1
    a = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a += c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


class _Mixer:
    """What a prediction reads of the nodes of one depth: sorted keys, weights and estimates."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, estimate: np.ndarray):
        self.keys, self.weight, self.estimate = keys, weight, estimate

    def mix(self, key: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of a 1 at these nodes, given that of one depth more."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        seen = self.keys[at] == key
        w = self.weight[at]
        return np.where(seen, w * self.estimate[at] + (1 - w) * deeper, deeper)


class _Level:
    """The nodes of one depth: sorted keys context << 8 | node, counts, and the weight of the node's own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _kt(zeros, ones)
        if below is None:
            self.log_w, self.weight = own, np.ones_like(own)
        else:
            self.log_w = np.logaddexp(own, below) + np.log(0.5)
            self.weight = np.exp(own + np.log(0.5) - self.log_w)

    def mixer(self) -> _Mixer:
        return _Mixer(self.keys, self.weight, (self.ones + 0.5) / (self.zeros + self.ones + 1.0))


def _nodes(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of zeros and ones at each (context, node)."""
    keys, zero, one = [], [], []
    for k in range(8):
        keys.append(context << U64(8) | (U64(1 << k) | byte >> U64(8 - k)))
        bit = (byte >> U64(7 - k)) & U64(1)
        one.append(np.where(bit == 1, n, 0))
        zero.append(np.where(bit == 0, n, 0))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return key, np.zeros(0), np.zeros(0)
    return key[edge], np.add.reduceat(np.concatenate(zero)[order].astype(np.float64), edge), np.add.reduceat(np.concatenate(one)[order].astype(np.float64), edge)


def _summed(parent: np.ndarray, value: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sum of ``value`` by ``parent``, in the order of ``keys``."""
    return np.bincount(np.searchsorted(keys, parent), weights=value, minlength=len(keys))


def build(code: np.ndarray, n: np.ndarray, low: int = 0) -> tuple[np.ndarray, _Level | None]:
    """Mixes depths DEPTH .. low for each code and bit: (codes x 8 probabilities of a 1, the level at depth ``low``)."""
    learned = n > 0
    byte_all = code & U64(255)
    p = np.full((8, len(code)), 0.5)
    level: _Level | None = None
    c, b, k = code[learned] >> U64(8), code[learned] & U64(255), n[learned]
    for d in range(DEPTH, low - 1, -1):
        shift = U64(8 * (DEPTH - d))
        keys, zeros, ones = _nodes(c >> shift, b, k)
        if not len(keys):
            return p, None
        below = None
        if level is not None:
            parent = (level.keys >> U64(16) << U64(8)) | (level.keys & U64(255))
            below = _summed(parent, level.log_w, keys)
        level = _Level(keys, zeros, ones, below)
        context, mixer = code >> U64(8) >> shift, level.mixer()
        for j in range(8):
            p[j] = mixer.mix(context << U64(8) | (U64(1 << j) | byte_all >> U64(8 - j)), p[j])
    return p, level


def log10_of(p: np.ndarray, byte: np.ndarray) -> np.ndarray:
    bits = np.stack([(byte >> U64(7 - k)) & U64(1) for k in range(8)])
    return np.log10(np.where(bits == 1, p, 1 - p)).sum(axis=0)


def _parents(level: _Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, zeros, ones and summed log weights of the nodes one depth up."""
    parent = (level.keys >> U64(16) << U64(8)) | (level.keys & U64(255))
    keys = np.unique(parent)
    return keys, *(_summed(parent, v, keys) for v in (level.zeros, level.ones, level.log_w))


def _model(spark: SparkSession, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(code, n, value): the log10 probability of each string's last byte after its context.

    Strings are dealt by their NEAR + 1 nearest context bytes and sorted; a task mixes the deeper levels of one run of
    whole contexts after another, in blocks of BUILD_BLOCK strings. The levels up to NEAR are sums over those.
    """
    near_shift = U64(8 * (DEPTH + 1 - (NEAR + 1)))

    def block(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        p, level = build(code, n, low=NEAR + 1)
        names = ["code", "n", "p", "below", "zeros", "ones"]
        for i in range(0, len(code), 1 << 16):
            q = np.ascontiguousarray(p[:, i : i + (1 << 16)].T)
            m = len(q)
            none = pa.nulls(m, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + m].view(np.int64)), pa.array(n[i : i + m]), pa.array([r.tobytes() for r in q], pa.binary()), none, none, none], names)
        if level is not None:
            keys, zeros, ones, below = _parents(level)
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *(pa.array(v) for v in (below, zeros, ones))], names)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for b in batches:
            code = np.concatenate([code, b.column(0).to_numpy().view(U64)])
            n = np.concatenate([n, b.column(1).to_numpy()])
            if len(code) >= BUILD_BLOCK:
                # up to the last change of context
                cut = int(np.searchsorted(code >> near_shift, code[-1] >> near_shift))
                if cut:
                    yield from block(code[:cut], n[:cut])
                    code, n = code[cut:], n[cut:]
        if len(code):
            yield from block(code, n)

    grams = counts.where(F.col("kind") == GRAM).select("code", "n")
    placed = grams.repartition(partitions(spark), F.shiftright("code", int(near_shift))).sortWithinPartitions("code")
    got = scratch.keep(placed.mapInArrow(deep, "code long, n long, p binary, below double, zeros double, ones double"), "deep")
    top = got.where("p is null").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).orderBy("code").toArrow()
    levels: list[_Level] = []
    if top.num_rows:
        parts = (top["code"].to_numpy().view(U64), *(top[c].to_numpy() for c in ("zeros", "ones", "below")))
        for _ in range(NEAR + 1):
            levels.append(_Level(*parts))
            parts = _parents(levels[-1])
    shared = spark.sparkContext.broadcast([level.mixer() for level in levels])
    del levels

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).to_numpy().view(U64)
            p = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(-1, 8).T.copy()
            byte = code & U64(255)
            for d, mixer in zip(range(NEAR, -1, -1), shared.value):
                context = code >> U64(8 * (DEPTH - d + 1))
                for j in range(8):
                    p[j] = mixer.mix(context << U64(8) | (U64(1 << j) | byte >> U64(8 - j)), p[j])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log10_of(p, byte))], ["code", "n", "value"])

    model = scratch.keep(got.where("p is not null").select("code", "n", "p").mapInArrow(shallow, "code long, n long, value double"), "model")
    shared.destroy()
    return model


class Table:
    """A table from 64-bit keys to floating-point values, built and read by whole arrays; its entries lie by hash, about one a bucket."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """values: none may be NaN; they keep their type."""
        bits = max(4, int(max(1, len(keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        # one more, so that the place of an empty last bucket can be read
        self.keys, self.values = np.append(keys[order], U64(0)), np.append(values[order], values.dtype.type(0))
        self.start = np.zeros((1 << bits) + 1, dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
        np.cumsum(np.bincount(home, minlength=1 << bits), out=self.start[1:])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> U64(29))) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is absent."""
        home = self._home(keys)
        place, end = self.start[home], self.start[home + 1]
        found = (self.keys[place] == keys) & (place < end)
        out = np.where(found, self.values[place], self.values.dtype.type(np.nan))
        todo = np.flatnonzero(~found & (place + 1 < end))
        place, end = place[todo] + 1, end[todo]
        while len(todo):
            found = self.keys[place] == keys[todo]
            out[todo[found]] = self.values[place[found]]
            more = ~found & (place + 1 < end)
            todo, place, end = todo[more], place[more] + 1, end[more]
        return out


def _commonest(table: DataFrame, most: int) -> int:
    """The least count that at most ``most`` entries reach."""
    have, least = 0, 1 << 62
    for r in table.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        have += r["rows"]
        if have > most:
            break
        least = r["n"]
    return least


def score(spark: SparkSession, docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, held_words: int = HELD_WORDS) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_bytes).

    Learns from the rows where ``learn`` is true (null: not) and scores all rows, whole texts; a null text counts
    as empty. Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over them; score is the log10 probability of the text under the context
    tree, bits_per_byte its code length by byte and close. With nothing to learn from every bit has probability 1/2.
    Repeated ids and rows are scored one by one; other columns are not read.
    """
    scratch = Scratch(spark, "ctw")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = scratch.keep(_counts(base).groupBy("kind", "code").agg(F.sum("n").alias("n")), "counts")
    words = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("code", "n")
    learned = base.where("learn").count()
    summary = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total = summary["n"] + learned
    distinct = summary["v"] + (1 if learned else 0)
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    model = _model(spark, counts, scratch)

    def table(rows: DataFrame, value: Column, least: int) -> Table:
        got = rows.where(F.col("n") >= least).select("code", value.alias("value")).toArrow()
        return Table(got["code"].to_numpy().view(U64), got["value"].to_numpy())

    gram_least, word_least = _commonest(model, held), _commonest(words, held_words)
    grams = spark.sparkContext.broadcast(table(model, F.col("value"), gram_least))
    vocab = spark.sparkContext.broadcast(table(words, F.log10(F.col("n") + F.lit(0.1)), word_least))
    end = float(np.log10(learned + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = grams.value, vocab.value

        def rest(code: np.ndarray, miss: np.ndarray, by: np.ndarray) -> pa.Array:
            off = np.concatenate([[0], np.cumsum(miss)])[by].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(off), pa.array(code[miss].view(np.int64)))

        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1), TEXT_BLOCK):
                code, by = gram_codes(data, at)
                value = g.get(code)
                miss = np.isnan(value)
                value = np.where(miss, 0, value).astype(np.float64)
                word, wby = word_hashes(data, at)
                wv = w.get(word)
                wmiss = np.isnan(wv)
                wv = np.concatenate([[0], np.cumsum(np.where(wmiss, 0, wv), dtype=np.float64)])
                known = np.concatenate([[0], np.cumsum(~wmiss)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(np.diff(at)),
                        pa.array(np.diff(wby) + 1),
                        pa.array(known[wby[1:]] - known[wby[:-1]]),
                        pa.array(wv[wby[1:]] - wv[wby[:-1]]),
                        pa.array(np.add.reduceat(value, by[:-1])),
                        rest(code, miss, by),
                        rest(word, wmiss, wby),
                    ],
                    ["id", "learn", "n_bytes", "n_tokens", "known", "words", "grams", "rest_grams", "rest_words"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    done = base.mapInArrow(run, f"id {kind}, learn boolean, n_bytes long, n_tokens long, known long, words double, grams double, rest_grams array<long>, rest_words array<long>")
    done = scratch.keep(done.withColumn("row", F.monotonically_increasing_id()), "scored")
    grams.destroy()
    vocab.destroy()
    # occurrences of strings and words outside the broadcast tables, joined with the whole tables
    far_grams = done.select("row", F.explode("rest_grams").alias("code")).join(model.where(F.col("n") < gram_least).select("code", "value"), "code")
    far_words = done.select("row", F.explode("rest_words").alias("code")).join(words.where(F.col("n") < word_least), "code", "left")
    zero, nothing = F.lit(0.0), F.lit(0).cast("long")
    parts = (
        done.select("row", "known", "words", "grams")
        .unionByName(far_grams.select("row", nothing.alias("known"), zero.alias("words"), F.col("value").alias("grams")))
        .unionByName(far_words.select("row", F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long").alias("known"), F.log10(F.coalesce("n", nothing) + F.lit(0.1)).alias("words"), zero.alias("grams")))
        .groupBy("row")
        .agg(F.sum("known").alias("k"), F.sum("words").alias("w"), F.sum("grams").alias("g"))
    )
    return done.select("row", "id", "learn", "n_bytes", "n_tokens").join(parts, "row").select(
        "id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("k") + F.lit(1 if learned else 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("w") + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        F.col("g").alias("score"),
        (-F.col("g") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        "n_bytes",
    )
