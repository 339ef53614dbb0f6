"""Structured Streaming forms: event-time windows, and keyed histograms with flush or decay in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeline.functions.segments import Segment
from gaugeline.operators import analysis
from gaugeline.operators.drift import ContinuousBaseline, Edges
from gaugeline.operators.numbering import number_rows
from gaugeline.streaming.monitors import histogram_divergences


def event_window(ts: str, duration: str, slide: str | None = None) -> Column:
    """A tumbling or sliding window; parquet times without a zone are taken in the session's."""
    return F.window(F.col(ts).cast("timestamp"), duration, slide)


def with_window(df: DataFrame, ts: str, duration: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Adds ``window``; on a stream, late rows are dropped after ``watermark``."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark is not None:
        df = df.withWatermark(ts, watermark)
    return df.withColumn("window", event_window(ts, duration, slide))


def windowed_data_bias(df: DataFrame, ts: str, duration: str, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window, metric, value), on batches and streams alike."""
    rows = with_window(df, ts, duration, slide, watermark)
    return analysis.data_bias_report(rows, feature, ground_truth, feature_segment, ground_truth_segment, by=["window"])


def windowed_model_bias(
    df: DataFrame, ts: str, duration: str, feature: str, ground_truth: str, prediction: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction_segment: Segment | Column, slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    rows = with_window(df, ts, duration, slide, watermark)
    return analysis.model_bias_report(rows, feature, ground_truth, prediction, feature_segment, ground_truth_segment, prediction_segment, by=["window"])


def windowed_linear(df: DataFrame, ts: str, duration: str, y_true: str, y_pred: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    return analysis.linear_report(with_window(df, ts, duration, slide, watermark), y_true, y_pred, by=["window"])


def windowed_counts(df: DataFrame, ts: str, duration: str, slide: str | None = None, watermark: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return with_window(df, ts, duration, slide, watermark).groupBy("window", *by).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, ts: str, gap: str, by: tuple[str, ...], watermark: str | None = None) -> DataFrame:
    """(by..., window, n): rows by session, which ends after a ``gap`` without rows."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.withWatermark(ts, watermark) if watermark is not None else df
    return df.groupBy(*by, F.session_window(ts, gap).alias("window")).agg(F.count("*").alias("n"))


def join_labels(predictions: DataFrame, truths: DataFrame, key: str, predicted_at: str | None = None, labelled_at: str | None = None, within: str | None = None) -> DataFrame:
    """Predictions with their later labels, by key.

    On streams give both times and ``within``: a label counts if it comes no later than that after its prediction,
    and the state of older rows is dropped.
    """
    if within is None:
        return predictions.join(truths, key)
    p = predictions.withColumn(predicted_at, F.col(predicted_at).cast("timestamp"))
    t = truths.withColumnRenamed(key, "_key").withColumn(labelled_at, F.col(labelled_at).cast("timestamp"))
    if predictions.isStreaming:
        p, t = p.withWatermark(predicted_at, within), t.withWatermark(labelled_at, within)
    late = F.col(labelled_at) <= F.col(predicted_at) + F.expr(f"interval {within}")
    return p.join(t, (F.col(key) == F.col("_key")) & (F.col(labelled_at) >= F.col(predicted_at)) & late).drop("_key")


def flush_windows(df: DataFrame, order: list[str], rate: int, by: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Adds ``flush_window``: which run of ``rate`` rows a row falls into, in order, by group.

    Rows are numbered by ``number_rows``: ties have one fixed order, ``unique`` says that there are none, and no task
    holds a group or all rows of one time.
    """
    numbered = number_rows(df, order, by or (), "_number", unique)
    return numbered.withColumn("flush_window", F.floor(F.col("_number") / F.lit(rate)).cast("long")).drop("_number")


def decayed_histogram(df: DataFrame, step: str, bin_col: str, last_step: int, half_life: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, c): the histogram after one computation at each step up to ``last_step``.

    Rows of step k have been multiplied last_step - k + 1 times by 0.5 ** (1 / half_life).
    """
    alpha = 0.5 ** (1.0 / half_life)
    weight = F.pow(F.lit(alpha), F.lit(last_step) - F.col(step) + 1)
    counted = df.groupBy(*by, step, bin_col).agg(F.count("*").alias("_c"))
    return counted.groupBy(*by, bin_col).agg(F.sum(F.col("_c") * weight).alias("c"))


class HistogramProcessor(StatefulProcessor):
    """Keeps a key's histogram in the state store and emits its drift metrics after every micro-batch.

    mode "flush": the window starts anew once it holds ``rate`` rows; rows of a batch are taken in order of ``order``.
    mode "decay": each emission first multiplies the histogram by ``rate`` (a factor below 1).
    """

    def __init__(self, edges: np.ndarray, shares: tuple[float, ...], mode: str, rate: float, value: str, order: str | None):
        self.edges, self.shares, self.mode, self.rate, self.value, self.order = edges, shares, mode, rate, value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("histogram", "bins array<double>, size double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held = self.state.get()
            bins, size = np.array(held[0]), float(held[1])
        else:
            bins, size = np.zeros(len(self.shares)), 0.0
        frames = [f for f in rows]
        data = pd.concat(frames) if len(frames) > 1 else frames[0]
        if self.order is not None:
            data = data.sort_values(self.order, kind="stable")
        values = data[self.value].dropna().to_numpy(dtype=float)
        if self.mode == "flush" and size + len(values) > self.rate:
            live = int((size + len(values) - 1) % self.rate) + 1
            bins, size, values = np.zeros(len(self.shares)), 0.0, values[len(values) - live :]
        place = np.searchsorted(self.edges, values, side="right")
        place = np.where(np.isnan(values) | (values < self.edges[0]), 0, np.where(values > self.edges[-1], len(self.shares) - 1, place))
        bins = bins + np.bincount(place, minlength=len(self.shares))
        size += len(values)
        if size:
            if self.mode == "decay":
                bins, size = bins * self.rate, size * self.rate
            got = histogram_divergences(np.array(self.shares), bins, size, True)
            yield pd.DataFrame({"key": [str(key[0])], "samples": [size], **{m: [v] for m, v in got.items()}})
        self.state.update((bins.tolist(), size))

    def close(self) -> None:
        """Nothing is held outside the state store."""


def live_drift(stream: DataFrame, key: str, value: str, baseline: ContinuousBaseline, mode: str = "flush", rate: float = 1_000_000, order: str | None = None, half_life: float | None = None) -> DataFrame:
    """A stream of (key, samples, the four metrics) after every micro-batch; needs the RocksDB state store."""
    factor = 0.5 ** (1.0 / half_life) if mode == "decay" and half_life else rate
    edges = baseline.edges.to_array() if isinstance(baseline.edges, Edges) else np.array(baseline.edges)
    processor = HistogramProcessor(edges, baseline.shares, mode, factor, value, order)
    schema = "key string, samples double, PopulationStabilityIndex double, KullbackLeibler double, JensenShannon double, WassersteinDistance double"
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")
