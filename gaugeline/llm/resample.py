"""Importance resampling towards a target collection, by hashed word n-grams.

Two collections are compared by the counts of their features (runs of up to ``runs`` words) in ``buckets`` hash buckets. A
bucket's gain says in thousandths how much likelier the target is to hold it; a document's weight is its features' mean
gain. Documents are drawn without replacement with chances in proportion to exp(weight / 1000), by adding Gumbel noise
that a hash of the id fixes and keeping the highest scores.

Scores are whole numbers within about 115 000 of each other whatever the corpus, so their histogram is small and exact.
Its suffix sums say how many documents stand above each score, hence where the cut lies and which rank a score's first
document has; only documents of one score are then numbered, by id. Nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._store import Scratch
from gaugeline.llm._text import chunks

#: Word bytes: digits, letters (A-Z folded first) and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B]

U32 = np.uint32
ONES = U32(0xFFFFFFFF)
#: Words of up to LONG bytes are hashed side by side, longer ones one by one.
LONG = 48


def _byte_table() -> np.ndarray:
    """The CRC-32 register after one byte, for each low byte of the register before."""
    x = np.arange(256, dtype=U32)
    for _ in range(8):
        x = (x >> U32(1)) ^ np.where(x & U32(1), U32(0xEDB88320), U32(0))
    return x


BYTE = _byte_table()


def _zeros_table() -> np.ndarray:
    """[n, i, b]: the register after n zero bytes where byte i of it was b and the others zero; registers add up by xor."""
    out = np.zeros((LONG + 1, 4, 256), dtype=U32)
    for i in range(4):
        x = np.arange(256, dtype=U32) << U32(8 * i)
        for n in range(LONG + 1):
            out[n, i] = x
            x = (x >> U32(8)) ^ BYTE[x & U32(255)]
    return out


ZEROS = _zeros_table()


def _shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes (LONG at most) each."""
    out = ZEROS[n, 0, x & U32(255)]
    for i in (1, 2, 3):
        out ^= ZEROS[n, i, (x >> U32(8 * i)) & U32(255)]
    return out


def feature_crcs(data: np.ndarray, at: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of every feature, its document, words of each document) of documents of bytes with n + 1 offsets.

    A register is linear in what came before: that of a run is the run's without its last word, moved on by that word's
    length, plus the word's own from a register of zero. So each word's bytes are read once, however many runs hold it.
    """
    data = FOLD[data]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = IS_WORD[data]
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner], last[inner - 1] = word[1:-1][inner], word[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    by = np.searchsorted(start, at)
    n_words = np.diff(by)
    doc = np.repeat(np.arange(len(n_words)), n_words)

    # each word's register from zero, longest words first so that those still to go are a prefix
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -LONG, side="left") :]
    zero = np.zeros(len(start), dtype=U32)
    if len(order):
        place, left, reg = start[order], size[order], np.zeros(len(order), dtype=U32)
        going = np.searchsorted(-left, -np.arange(int(left[0])), side="left")
        for k, m in enumerate(going.tolist()):
            r = reg[:m]
            reg[:m] = (r >> U32(8)) ^ BYTE[(r ^ data[place[:m] + k]) & U32(255)]
        zero[order] = reg
    far = np.flatnonzero(size > LONG)
    bodies = {i: data[start[i] : end[i]].tobytes() for i in far.tolist()}

    def moved(reg: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Registers after each one's word."""
        out = _shifted(reg, np.minimum(size[words], LONG)) ^ zero[words]
        for k in np.flatnonzero(size[words] > LONG).tolist():
            # crc32(b, c) goes on from the register ~c and returns its complement
            out[k] = ~U32(zlib.crc32(bodies[int(words[k])], int(~reg[k])))
        return out

    every = np.arange(len(start))
    reg = moved(np.full(len(start), ONES), every)
    crcs, docs, from_ = [~reg], [doc], every
    for k in range(1, runs):
        stays = (from_ + k < len(start)) & (doc[np.minimum(from_ + k, max(len(start) - 1, 0))] == doc[from_])
        from_, reg = from_[stays], reg[stays]
        reg = moved((reg >> U32(8)) ^ BYTE[(reg ^ U32(32)) & U32(255)], from_ + k)
        crcs.append(~reg)
        docs.append(doc[from_])
    return np.concatenate(crcs), np.concatenate(docs), n_words


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts. Tasks add up their own, so ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                have += np.bincount(feature_crcs(data, at, runs)[0] % U32(buckets), minlength=buckets)
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(have[some])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to each count."""
    k = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1.0) * (s.sum() + k)) / ((s + 1.0) * (t.sum() + k))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str, runs: int) -> DataFrame:
    """docs without their text, with n_words, n_features and weight (floored mean gain, 0 without features)."""
    kept = [c for c in docs.columns if c != text_col]
    buckets = U32(len(gain))
    schema = T.StructType([f for f in docs.schema if f.name != text_col]).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, data, at in chunks(texts):
                crcs, doc, n_words = feature_crcs(data, at, runs)
                n = np.bincount(doc, minlength=hi - lo)
                # whole numbers below 2**53 in all, so the sums are exact
                total = np.bincount(doc, weights=gain[crcs % buckets], minlength=hi - lo).astype(np.int64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    [*kept, "n_words", "n_features", "weight"],
                )

    return docs.mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for u from the first 32 bits of the SHA-256 of ``seed:id``; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    runs: int = 2, buckets: int = 10000, seed: int = 7, percent: int = 25, least_words: int = 20,
) -> DataFrame:
    """One row per document: id_col, n_words, n_features, weight, score, rank.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn, those with the highest
    scores, ties to the smaller id; rank counts them from 1, others have null. Words are runs of digits, letters and
    characters beyond ASCII, A-Z lower-cased; features are all runs of 1 to ``runs`` words, repeats counted.

    Counts cover all texts of both tables. A null or empty text has no words, no features, weight 0 and is not drawn; texts
    are read whole. Null ids come after all others of their score, and rows of one id and score in any order (they share
    their noise, so equal rows are drawn side by side). Empty tables are allowed on either side. Other columns are not read.
    """
    if not (1 <= runs and 1 <= buckets < 2**31 and 0 <= percent <= 100):
        raise ValueError("runs and buckets must be positive, percent within 0 and 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows, "text", runs, buckets), bucket_counts(target, target_text, runs, buckets))
    scratch = Scratch(spark, "resample")
    scored = scratch.keep(weigh(rows, gain, "text", runs).withColumn("score", F.col("weight") + gumbel("id", seed)), "scored")
    able = F.col("n_words") >= least_words
    hist = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).toPandas()
    score, n = hist["score"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    order = np.argsort(-score)
    score, n = score[order], n[order]
    above = np.cumsum(n) - n
    draw = percent * int(n.sum()) // 100
    score, above = score[above < draw], above[above < draw]
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    names = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank"]
    if not len(score):
        return none.select(*names)
    offsets = spark.createDataFrame(pa.table({"score": pa.array(score), "above": pa.array(above)}))
    reached = able & (F.col("score") >= F.lit(int(score[-1])))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight"))
    drawn = scored.where(reached).join(F.broadcast(offsets), "score").withColumn("rank", F.col("above") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.select(*names).unionByName(none.where(~reached).select(*names))
