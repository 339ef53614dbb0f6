"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._skew import join_by_key
from gaugeline.llm._store import Scratch


#: Edges that fit into one task whatever they share; more are joined so that no node's edges meet in one.
FEW = 100_000


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id reachable): trees are hooked to their smallest neighbour and flattened until none is left to hook."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return ids, ids[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _settled(now: DataFrame) -> DataFrame:
    """(id, component) of less than FEW edges, in one task and one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            ids, label = _labels(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "component"])

    return now.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def _joined(rows: DataFrame, low: DataFrame, total: int, other: str) -> DataFrame:
    return rows.join(low, "u") if total < FEW else join_by_key(rows, low, ["u"], total, F.col(other))


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (columns src, dst); component is the smallest id reachable.

    Each step rewires every edge to the smallest neighbour, so the graph turns into stars in a number of
    rounds that grows with the logarithm of its size. A node's neighbours are only ever reduced by ``min``
    (combined before the shuffle) and joined back; the edges of a node that has very many are dealt by both ends.
    Self-loops and repeated edges are allowed; null ends are ignored. An empty table gives an empty result. Once there are
    less than FEW edges, one task settles them: a step costs the driver a dozen plans however few they are.
    """
    now = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
        .distinct()
    )
    now = scratch.keep(now, f"{name}-0")
    before = _size(now)
    k = 0
    while before[0] and k < max_rounds:
        if before[0] < FEW:
            return _settled(now)
        k += 1
        # large star: each node's larger neighbours move to its smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members")).select("u", F.least("u", "m").alias("m"), "members")
        large = _joined(now.select(F.col("u").alias("big"), F.col("v").alias("u")), low, before[0], "big").select(F.col("big").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each node's smaller neighbours, and itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members"))
        small = _joined(large, low, before[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = scratch.keep(small.where("u <> v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        after = _size(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(
        now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    )
