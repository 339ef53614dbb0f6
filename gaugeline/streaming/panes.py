"""Sliding windows by panes: every row is counted once, in its pane, and windows share the panes' cells.

``functions.window`` copies each row into all the windows that hold it, duration / slide of them. Here a pane is as long as
duration and slide divide evenly, rows are combined into cells a pane before the shuffle, and only these travel. A window is
put together from two running totals and no subtraction, so sums of fractions keep their digits and maxima work as sums do:
the panes are cut into blocks as long as a window, and a window is the end of one block and the beginning of the next.
Totals run within (group, block), so no task holds the history of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.segments import Segment
from gaugeline.operators import analysis

Count = Callable[[DataFrame, Sequence[str]], DataFrame]


def _micros(duration: str) -> int:
    return pd.Timedelta(duration) // pd.Timedelta(microseconds=1)


def _spans(duration: str, slide: str) -> tuple[int, int, int]:
    """(pane, window, slide) in microseconds."""
    d, s = _micros(duration), _micros(slide)
    if not 0 < s <= d:
        raise ValueError("a window slides by more than nothing and at most by its duration")
    return math.gcd(d, s), d, s


def pane_cells(df: DataFrame, ts: str, duration: str, slide: str, count: Count, by: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """(by..., pane, cells...): the cells of each pane that has rows; pane is a window struct.

    count(df, by) gives cells by group, as the functions of ``operators.analysis`` do. Rows without a time are left out.
    On a stream with ``watermark`` a pane is appended once it is over, and rows that come later are dropped.
    """
    pane, _, _ = _spans(duration, slide)
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark(ts, watermark)
    return count(rows.withColumn("pane", F.window(ts, f"{pane} microseconds")), [*by, "pane"])


def _merged(cell: str) -> Callable[[Column | str], Column]:
    return F.max if cell.startswith("max_") else F.min if cell.startswith("min_") else F.sum


def window_cells(panes: DataFrame, duration: str, slide: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., window, cells...): the windows that hold a pane of the table, each with its panes' cells together.

    Cells named ``max_...`` or ``min_...`` are maxima and minima, all others sums. A pane may have several rows (written by
    several batches, say). Windows start at multiples of ``slide`` from 1970 on and end before their end, as Spark's do.
    """
    pane, d, s = _spans(duration, slide)
    k, step = d // pane, s // pane
    by = [*by]
    names = [c for c in panes.columns if c not in {*by, "pane"}]
    keys = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    held = panes.select(*keys, F.floor(F.unix_micros("pane.start") / F.lit(pane)).alias("_at"), *[F.col(c).alias(f"_c{j}") for j, c in enumerate(names)])
    groups, cells = [f"_g{i}" for i in range(len(by))], {f"_c{j}": _merged(c) for j, c in enumerate(names)}
    at = F.col("_at")
    block = F.floor(at / F.lit(k))
    # a pane ends windows that start in the block before; its block's last pane ends none of these
    roles = F.array(F.struct(block.alias("block"), F.lit(False).alias("tail")), F.struct((block - 1).alias("block"), F.lit(True).alias("tail")))
    dealt = held.select("*", F.inline(roles)).where(~F.col("tail") | (at < (F.col("block") + 2) * k - 1)).repartition(*groups, "block")
    # heads add up from their block's end backwards, tails from their block's beginning on
    near = dealt.groupBy(*groups, "block", "tail", "_at").agg(*[merge(c).alias(c) for c, merge in cells.items()]).withColumn("turn", F.when(F.col("tail"), at).otherwise(-at))
    order = Window.partitionBy(*groups, "block", "tail").orderBy("turn")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = near.withColumn("after", F.lead("turn").over(order)).withColumns({c: merge(c).over(running) for c, merge in cells.items()})
    # a head's total holds for starts from behind the pane before it, a tail's for ends up to the pane after it
    first = F.when(F.col("tail"), at - k + 1).otherwise(F.coalesce(1 - F.col("after"), F.col("block") * k))
    last = F.when(F.col("tail"), F.coalesce(F.col("after") - 1, (F.col("block") + 2) * k - 2) - k + 1).otherwise(at)
    fitting = F.ceil(first / F.lit(step)).cast("long") * step
    starts = F.when(fitting <= last, F.sequence(fitting, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    parts = told.select(*groups, "block", F.explode(starts).alias("start"), *cells)
    out = parts.groupBy(*groups, "block", "start").agg(*[merge(c).alias(c) for c, merge in cells.items()])
    begins = F.col("start") * pane
    window = F.struct(F.timestamp_micros(begins).alias("start"), F.timestamp_micros(begins + d).alias("end")).alias("window")
    return out.select(*[F.col(g).alias(b) for g, b in zip(groups, by, strict=True)], window, *[F.col(f"_c{j}").alias(c) for j, c in enumerate(names)])


def sliding_cells(df: DataFrame, ts: str, duration: str, slide: str, count: Count, by: Sequence[str] = ()) -> DataFrame:
    """(by..., window, cells...) of a table."""
    return window_cells(pane_cells(df, ts, duration, slide, count, by), duration, slide, by)


def sliding_counts(df: DataFrame, ts: str, duration: str, slide: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., window, n)."""
    return sliding_cells(df, ts, duration, slide, lambda d, g: d.groupBy(*g).agg(F.count("*").alias("n")), by)


def sliding_report(df: DataFrame, ts: str, duration: str, slide: str, family: str, count: Count, by: Sequence[str] = ()) -> DataFrame:
    """(by..., window, metric, value): a family's metrics from the cells that ``count`` gives."""
    return analysis.finish(sliding_cells(df, ts, duration, slide, count, by), family, [*by, "window"])


def sliding_data_bias(df: DataFrame, ts: str, duration: str, slide: str, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, by: Sequence[str] = ()) -> DataFrame:
    facet, label = analysis.boolean(df, feature, feature_segment), analysis.boolean(df, ground_truth, ground_truth_segment)
    return sliding_report(df, ts, duration, slide, "data_bias", lambda d, g: analysis.facet_counts(d, facet, label, g), by)


def sliding_linear(df: DataFrame, ts: str, duration: str, slide: str, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    return sliding_report(df, ts, duration, slide, analysis.LINEAR, lambda d, g: analysis.regression_sums(d, F.col(y_true), F.col(y_pred), g), by)
