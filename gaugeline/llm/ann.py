"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: unit vectors are centred, turned onto their principal axes and rotated so that their signs lose least
(iterative quantisation); several rotations are put side by side until the code has BITS bits. A code is split into
byte substrings, each with posting lists. By the pigeonhole principle a code within radius r of the query differs
from it by at most r // m bits in one of m substrings (one bit less in all but the first r % m + 1), so probing
those values retrieves every code within r. The radius is learned: nearly all true neighbours of a sample lie in it.
Retrieved rows are reranked by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm._store import Scratch

BITS = 256
#: Rows to learn rotations and radius from, and how many of them serve as queries there.
SAMPLE, SAMPLE_QUERIES = 20_000, 500
#: The share of a sample's true neighbours that the radius must cover.
COVER = 0.985
#: Queries that are searched in one pass over the rows.
QUERY_BLOCK = 4096
#: Rows in a block of the stored index.
INDEX_ROWS = 10_000

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: NEAR[s][v]: the byte values within s bits of v.
_NEAR = [np.array([np.flatnonzero(_POP[np.arange(256) ^ v] <= s) for v in range(256)]) for s in range(9)]


def usable(vec: str, dim: int) -> Column:
    """Vectors of ``dim`` finite components that are not all zero."""
    return F.expr(f"coalesce(size({vec}) = {dim} and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vec}, x -> x <> 0), false)")


class Coder:
    """Centre and rotations; ``codes`` gives packed bits."""

    def __init__(self, x: np.ndarray, bits: int = BITS, seed: int = 3):
        rng = np.random.default_rng(seed)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        v = centred @ axes.T
        dim = x.shape[1]
        turns = []
        for _ in range(-(-bits // dim)):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(20):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(axes.T @ r)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def codes(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.turn >= 0, axis=1)


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return _POP[codes ^ query].sum(axis=1, dtype=np.int64)


class MultiIndex:
    """Posting lists of every byte substring of a block of codes; ``pack`` and ``unpack`` move it to a table and back."""

    def __init__(self, codes: np.ndarray, order: np.ndarray | None = None):
        self.codes = codes
        n, self.m = codes.shape
        self.order = order if order is not None else np.concatenate([np.argsort(codes[:, j], kind="stable") for j in range(self.m)]).astype(np.int32)
        count = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.length = count.reshape(-1)
        self.start = (np.cumsum(count, axis=1) - count + n * np.arange(self.m)[:, None]).reshape(-1)

    def pack(self) -> tuple[bytes, bytes]:
        return self.codes.tobytes(), self.order.tobytes()

    @classmethod
    def unpack(cls, codes: bytes, order: bytes, n: int) -> MultiIndex:
        return cls(np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(order, np.int32))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within ``radius`` of the query's."""
        s, rest = divmod(radius, self.m)
        base = 256 * np.arange(self.m)
        probes = (_NEAR[min(s, 8)][query[: rest + 1]] + base[: rest + 1, None]).reshape(-1)
        if s > 0 and rest + 1 < self.m:
            probes = np.concatenate([probes, (_NEAR[min(s - 1, 8)][query[rest + 1 :]] + base[rest + 1 :, None]).reshape(-1)])
        size = self.length[probes]
        end = np.cumsum(size)
        at = np.repeat(self.start[probes] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        mask = np.zeros(len(self.codes), dtype=bool)
        mask[self.order[at]] = True
        found = np.flatnonzero(mask)
        return found[distances(self.codes[found], query) <= radius]


def cosines(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, in double precision; equal rows give equal values."""
    x, query = x.astype(np.float64), query.astype(np.float64)
    return (x * query).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((query * query).sum()))


def learn_radius(coder: Coder, x: np.ndarray, k: int, queries: int = SAMPLE_QUERIES, cover: float = COVER) -> int:
    """The code distance within which ``cover`` of the sample's true k nearest lie."""
    codes = coder.codes(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        sim = unit @ unit[i]
        sim[i] = -2
        near = np.argpartition(-sim, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        far.append(distances(codes[near], codes[i]))
    return int(np.quantile(np.concatenate(far), cover)) if far and len(x) > 1 else 8 * codes.shape[1]


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search(
    spark: SparkSession,
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    bits: int = BITS,
    sample: int = SAMPLE,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine, itself left out; ties to the smaller id.

    Vectors that are null, zero, of an unusual length or hold null or non-finite components take no part, nor do rows
    with a null id. Rows are told apart by a number: those that share an id, or are equal, are queries and candidates
    each, so a repeated query id has k rows for every row of it, and only a query's own row is left out. Every row is
    indexed once, in blocks of INDEX_ROWS rows that are stored with their posting lists, and searched by blocks of
    ``query_block`` queries; a task keeps only the k best of its rows for each query. Queries for which the radius
    gives fewer than k rows are searched again without a radius. Rotations and radius are learned from at most
    ``sample`` rows. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "ann")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null")
    common = base.where("size(vec) > 0").groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    base = scratch.keep(base.where(usable("vec", dim)).withColumn("row", F.monotonically_increasing_id()), "vectors")

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy().reshape(len(column), dim)

    picked = base.orderBy(F.xxhash64("id", F.lit("sample")), "id", "row").limit(sample).select("vec").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], schema)
    x = matrix(picked["vec"])
    coder = Coder(x, bits)
    radius = learn_radius(coder, x, k)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(i, INDEX_ROWS)
                x = matrix(part.column(2))
                packed = (part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), x.tobytes(), *MultiIndex(coder.codes(x)).pack())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed], ["rows", "ids", "vecs", "codes", "lists"])

    stored = scratch.keep(base.select("row", "id", "vec").mapInArrow(store, "rows binary, ids binary, vecs binary, codes binary, lists binary"), "index")

    def run_pass(queries: DataFrame, block: int, reach: int) -> DataFrame:
        got = queries.select("row", "id", "vec").toArrow()
        q_rows, q_ids, q = got["row"].to_numpy(), got["id"].to_numpy(), matrix(got["vec"])
        shared = spark.sparkContext.broadcast((q_rows, q_ids, q, coder.codes(q) if len(q) else np.zeros((0, bits // 8), np.uint8)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_rows, q_ids, q, q_codes = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_rows)
            for batch in batches:
                for r, i, v, c, o in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    own, ids = np.frombuffer(r, np.int64), np.frombuffer(i, np.int64)
                    x, index = np.frombuffer(v, np.float64).reshape(len(ids), dim), MultiIndex.unpack(c, o, len(ids))
                    for j in range(len(q_rows)):
                        at = index.within(q_codes[j], reach)
                        at = at[own[at] != q_rows[j]]
                        if len(at):
                            score = np.concatenate([best[j][0], cosines(x[at], q[j])])
                            who = np.concatenate([best[j][1], ids[at]])
                            top = _top(score, who, k)
                            best[j] = (score[top], who[top])
            size = np.array([len(b[0]) for b in best], dtype=np.int64)
            if size.sum():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_rows, size)), pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))],
                    ["query_row", "query_id", "vec_id", "score"],
                )

        near = stored.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
        order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return scratch.keep(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score"), f"block-{block}")

    wanted = base.where("is_query")
    blocks = max(1, -(-wanted.count() // query_block))
    total = base.count()
    parts = []
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == b)
        found = run_pass(own, 2 * b, radius)
        # too few in the radius: all rows are within the code's full length
        short = own.join(found.groupBy("query_row").agg(F.count("*").alias("n")), F.col("row") == F.col("query_row"), "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select("row", "id", "vec")
        if not short.isEmpty():
            more = run_pass(short, 2 * b + 1, bits)
            found = found.join(more.select("query_row").distinct(), "query_row", "left_anti").unionByName(more)
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
