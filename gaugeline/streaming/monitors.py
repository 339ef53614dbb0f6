"""Monitors: a fixed baseline report and mergeable runtime cells, fed by DataFrames or single values.

The runtime state is a handful of numbers (a histogram for drift), whatever the number of rows pushed. A monitor is
idempotent towards ``foreachBatch``: a batch id that is not larger than the last one is skipped. With a folder for its
state it goes on after a restart of the driver. Single values are counted in the driver's process, without a job.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError, EmptyDatasetError
from gaugeline.functions import cells as C
from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS, drift_names
from gaugeline.functions.segments import LabeledSegment, Segment, judged
from gaugeline.operators import analysis
from gaugeline.operators.api import check_cells
from gaugeline.operators.drift import EPS, CategoricalBaseline, ContinuousBaseline, QuantileType, bin_of
from gaugeline.operators.numbering import number_rows
from gaugeline.operators.reports import STABILITY_EPS, THRESHOLD, drift_report_dict, drift_snapshot, report_to_dict, snapshot_failures


class _Kept:
    """Runtime state that can be written and taken up again; the baseline is what the constructor is given.

    Two slots of a folder are overwritten in turn, so one is whole whenever a write is cut off. A batch that was counted
    after the last write is replayed by the stream, one that was counted before is skipped by its id.
    """

    spark: SparkSession
    _last_batch: int
    _saves = 0

    def state(self) -> dict[str, Any]:
        """The runtime's numbers, as JSON can hold them."""
        raise NotImplementedError

    def restore(self, state: dict[str, Any]) -> None:
        """Takes up a state of a monitor with the same baseline."""
        raise NotImplementedError

    def save(self, folder: str) -> None:
        self._saves += 1
        line = json.dumps({"saves": self._saves, "last_batch": self._last_batch, "state": self.state()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{self._saves % 2}")

    def load(self, folder: str) -> bool:
        """Takes up the folder's latest state, if there is one."""
        kept = []
        for slot in (0, 1):
            try:
                kept += [json.loads(r["value"]) for r in self.spark.read.text(f"{folder}/{slot}").collect()]
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        if kept:
            last = max(kept, key=lambda k: k["saves"])
            self.restore(last["state"])
            self._saves, self._last_batch = last["saves"], last["last_batch"]
        return bool(kept)

    def _each_batch(self, push: Callable[[DataFrame, int], None], state: str | None) -> Callable[[DataFrame, int], None]:
        if state is None:
            return push
        self.load(state)

        def kept(df: DataFrame, batch_id: int) -> None:
            push(df, batch_id)
            self.save(state)

        return kept


def _plain(values: Iterable[Any]) -> list[Any]:
    return [v.item() if isinstance(v, np.generic) else v for v in values]


def _number(value: Any) -> float | None:
    return float(value) if type(value) in (int, float) else None


class _Monitor(_Kept):
    """Shared surface: push, flush, reset, snapshots and reports over a family's cells."""

    family: str
    cell_names: tuple[str, ...]
    flush_on_reset = False
    #: Decimal places of reports and of their distances, as a threshold sees them; None: all.
    digits: int | None = None

    def __init__(self, spark: SparkSession, eps: float = STABILITY_EPS):
        self.spark, self.eps = spark, eps
        self._last_batch = -1
        self.flush()

    # what a monitor counts
    def _count(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        """One row's cells, its values in the order of a push; None where a job has to count it."""
        raise NotImplementedError

    def _push_one(self, names: Sequence[str], values: Iterable[Any]) -> None:
        """Adds one row; a null leaves it out."""
        row = _plain(values)
        if any(v is None for v in row):
            return
        cells = self._cells_of(*row)
        if cells is None:
            self.push_batch(self.spark.createDataFrame([tuple(row)], list(names)))
        else:
            self.cells = C.merge(self.cells, cells)

    def state(self) -> dict[str, Any]:
        return {"cells": dict(self.cells)}

    def restore(self, state: dict[str, Any]) -> None:
        if set(state["cells"]) != set(self.cell_names):
            raise BaselineError("the state is of another kind of monitor")
        self.cells = {c: state["cells"][c] for c in self.cell_names}

    def _collected(self, df: DataFrame) -> dict[str, float]:
        row = self._count(df).first()
        return {c: row[c] for c in self.cell_names}

    def flush(self) -> None:
        """Forgets the runtime cells."""
        self.cells: dict[str, float] = {c: 0 for c in self.cell_names}

    def push_batch(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Adds a DataFrame's rows: one aggregate job, one row to the driver."""
        if batch_id is not None:
            if batch_id <= self._last_batch:
                return
            self._last_batch = batch_id
        self.cells = C.merge(self.cells, self._collected(df))

    update_stream_batch = push_batch

    def foreach_batch(self, state: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``; state: a shared folder in which the runtime outlives the driver."""
        return self._each_batch(self.push_batch, state)

    def _set_baseline(self, df: DataFrame) -> None:
        cells = self._collected(df)
        check_cells(cells, self.family)
        self.baseline = self._report(cells)

    def _report(self, cells: dict[str, float]) -> DataFrame:
        one = self.spark.createDataFrame([tuple(float(cells[c]) for c in self.cell_names)], ", ".join(f"{c} double" for c in self.cell_names))
        return self._cut(analysis.finish(one, self.family))

    def _cut(self, report: DataFrame) -> DataFrame:
        return report if self.digits is None else report.withColumn("value", F.round(F.col("value"), self.digits) + F.lit(0.0))

    def _drift(self, metrics: Iterable[str] | None = None) -> DataFrame:
        return self._cut(drift_snapshot(self._runtime(), self.baseline, self.family, metrics, eps=self.eps))

    def reset_baseline(self, df: DataFrame) -> None:
        self._set_baseline(df)
        if self.flush_on_reset:
            self.flush()

    def _runtime(self) -> DataFrame:
        if not any(self.cells.values()):
            raise EmptyDatasetError("nothing was pushed since the last flush")
        if self.family == DATA_BIAS:
            check_cells(self.cells, self.family)
        return self._report(self.cells)

    def performance_snapshot(self) -> dict[str, float]:
        return report_to_dict(self._runtime())

    def drift_snapshot(self) -> dict[str, float]:
        return report_to_dict(self._drift())

    def drift_report(self, drift_threshold: float = THRESHOLD) -> dict:
        return self.drift_report_partial_metrics(None, drift_threshold)

    def drift_report_partial_metrics(self, metrics: Iterable[str] | None, drift_threshold: float = THRESHOLD) -> dict:
        return drift_report_dict(snapshot_failures(self._drift(metrics), drift_threshold))


class DataBiasStreaming(_Monitor):
    """A reset of the baseline also flushes. With ``digits``, reports are rounded before they are compared, as stored ones are."""

    family, cell_names, flush_on_reset = DATA_BIAS, C.FACET_CELLS, True

    def __init__(self, df: DataFrame, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, eps: float = STABILITY_EPS, digits: int | None = None):
        self.columns, self.segments, self.digits = (feature, ground_truth), (feature_segment, ground_truth_segment), digits
        super().__init__(df.sparkSession, eps)
        self._set_baseline(df)

    def _count(self, df: DataFrame) -> DataFrame:
        return analysis.facet_counts(df, *(analysis.boolean(df, c, s) for c, s in zip(self.columns, self.segments, strict=True)))

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        sides = [judged(s, v) for s, v in zip(self.segments, values, strict=True)]
        return None if None in sides else C.facet_cells_of(*sides)

    def push(self, feature_value: Any, ground_truth_value: Any) -> None:
        self._push_one(self.columns, (feature_value, ground_truth_value))

    def reset_baseline_and_segmentation_criteria(self, df: DataFrame, feature_segment: Segment | Column, ground_truth_segment: Segment | Column) -> None:
        """New criteria change what the cells mean, so the runtime is flushed too."""
        self.segments = (feature_segment, ground_truth_segment)
        self._set_baseline(df)
        self.flush()


class ModelBiasStreaming(_Monitor):
    """A reset of the baseline keeps the runtime."""

    family, cell_names = MODEL_BIAS, C.MODEL_CELLS

    def __init__(self, df: DataFrame, feature: str, ground_truth: str, prediction: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction_segment: Segment | Column):
        self.columns, self.segments = (feature, ground_truth, prediction), (feature_segment, ground_truth_segment, prediction_segment)
        super().__init__(df.sparkSession)
        self._set_baseline(df)

    def _set_baseline(self, df: DataFrame) -> None:
        cells = self._collected(df)
        if not sum(cells.values()):
            raise EmptyDatasetError("the baseline has no rows")
        check_cells(cells, self.family)
        self.baseline = self._report(cells)

    def _count(self, df: DataFrame) -> DataFrame:
        return analysis.model_counts(df, *(analysis.boolean(df, c, s) for c, s in zip(self.columns, self.segments, strict=True)))

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        sides = [judged(s, v) for s, v in zip(self.segments, values, strict=True)]
        return None if None in sides else C.model_cells_of(*sides)

    def push(self, feature: Any, prediction: Any, ground_truth: Any) -> None:
        self._push_one(self.columns, (feature, ground_truth, prediction))

    def reset_baseline_and_segmentation_criteria(self, df: DataFrame, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction_segment: Segment | Column) -> None:
        self.segments = (feature_segment, ground_truth_segment, prediction_segment)
        self._set_baseline(df)
        self.flush()


class _Performance(_Monitor):
    def __init__(self, df: DataFrame, y_true: str, y_pred: str):
        self.y_true, self.y_pred = y_true, y_pred
        super().__init__(df.sparkSession)
        self._set_baseline(df)

    def update_stream(self, y_true: Any, y_pred: Any) -> None:
        self._push_one((self.y_true, self.y_pred), (y_true, y_pred))


class BinaryClassificationStreaming(_Performance):
    """Positive class ``label`` of any type; a reset of the baseline also flushes."""

    family, cell_names, flush_on_reset = analysis.BINARY, C.CONFUSION_CELLS, True

    def __init__(self, df: DataFrame, label: Any, y_true: str, y_pred: str):
        self.label = label
        super().__init__(df, y_true, y_pred)

    def _count(self, df: DataFrame) -> DataFrame:
        one = LabeledSegment(self.label)
        return analysis.confusion_counts(df, one.column(F.col(self.y_true)), one.column(F.col(self.y_pred)))

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        sides = [judged(LabeledSegment(self.label), v) for v in values]
        return None if None in sides else C.confusion_cells_of(*sides)

    def reset_baseline_and_label(self, df: DataFrame, label: Any) -> None:
        self.label = label
        self.reset_baseline(df)


class LinearRegressionStreaming(_Performance):
    """A reset of the baseline keeps the runtime."""

    family, cell_names = analysis.LINEAR, C.REGRESSION_CELLS

    def _count(self, df: DataFrame) -> DataFrame:
        return analysis.regression_sums(df, F.col(self.y_true), F.col(self.y_pred))

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        t, p = map(_number, values)
        return None if t is None or p is None else C.regression_cells_of(t, p)


class LogisticRegressionStreaming(_Performance):
    """The truth is positive where it is 1; resets of baseline and threshold keep the runtime."""

    family, cell_names = analysis.LOGISTIC, (*C.CONFUSION_CELLS, "penalty")

    def __init__(self, df: DataFrame, y_true: str, y_pred: str, decision_threshold: float = 0.5, eps: float = C.EPS):
        self.threshold, self.log_eps = decision_threshold, eps
        super().__init__(df, y_true, y_pred)

    def _count(self, df: DataFrame) -> DataFrame:
        return analysis.logistic_counts(df, F.col(self.y_true), F.col(self.y_pred), F.col(self.y_true).cast("double") == 1.0, self.threshold, eps=self.log_eps)

    def _cells_of(self, *values: Any) -> dict[str, float] | None:
        t, p = map(_number, values)
        if t is None or p is None:
            return None
        return C.confusion_cells_of(t == 1.0, p >= self.threshold) | {"penalty": C.log_penalty_of(t, p, self.log_eps)}

    def reset_baseline_and_decision_threshold(self, df: DataFrame, decision_threshold: float) -> None:
        self.threshold = decision_threshold
        self.reset_baseline(df)


FLUSH_RATE, FLUSH_CADENCE, DECAY_HALF_LIFE = 1_000_000, 86_400, 86_400
#: The clock is looked at when this many rows divide the window's size.
CLOCK_EVERY = 256
_OTHER = None


class _DriftMonitor(_Kept):
    """A baseline histogram and the runtime's; ``bins`` maps a bin (or label) to its weight."""

    def __init__(self, df: DataFrame, column: str, eps: float = EPS):
        self.spark, self.column, self.eps = df.sparkSession, column, eps
        self._last_batch = -1
        self.reset_baseline(df)

    def reset_baseline(self, df: DataFrame) -> None:
        """Fits anew by the same rule, clears the runtime and restarts the clock."""
        self._fit(df)
        self._clear()

    def _clear(self) -> None:
        self.bins = {k: 0.0 for k in self.shares}
        self.size = 0.0
        self._since = time.monotonic()

    def state(self) -> dict[str, Any]:
        return {"bins": [[k, v] for k, v in self.bins.items()], "size": self.size, "age": time.monotonic() - self._since, "at": time.time()}

    def restore(self, state: dict[str, Any]) -> None:
        bins = {k: v for k, v in state["bins"]}
        if bins.keys() != self.shares.keys():
            raise BaselineError("the state was counted against another baseline")
        self.bins, self.size = {k: bins[k] for k in self.shares}, state["size"]
        # the clock went on while no monitor was there
        self._since = time.monotonic() - state["age"] - max(0.0, time.time() - state["at"])

    # one value
    def _before_push(self) -> None:
        """Hook of the flush mode."""

    def update_stream(self, example: Any) -> None:
        self._before_push()
        self.bins[self._bin(example)] += 1.0
        self.size += 1.0

    def _add(self, counted: DataFrame) -> int:
        n = 0
        for r in counted.collect():
            self.bins[r["bin"]] += float(r["c"])
            n += r["c"]
        self.size += float(n)
        return n

    def update_stream_batch(self, df: DataFrame, batch_id: int | None = None, order: str | Column | None = None) -> None:
        """Adds a DataFrame's rows: one histogram job. ``order`` says which rows come last, for flushing within a batch."""
        if batch_id is not None:
            if batch_id <= self._last_batch:
                return
            self._last_batch = batch_id
        self._push(df.where(F.col(self.column).isNotNull()), order)

    def foreach_batch(self, order: str | Column | None = None, state: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``; state: a shared folder in which the runtime outlives the driver."""
        return self._each_batch(lambda df, batch_id: self.update_stream_batch(df, batch_id, order), state)

    def _push(self, df: DataFrame, order: str | Column | None) -> None:
        self._add(self._binned(df))

    def _before_compute(self) -> None:
        """Hook of the decay mode."""

    def compute_drift(self, drift_metric: str) -> float:
        return self.compute_drift_multiple_criteria([drift_metric])[0]

    def compute_drift_multiple_criteria(self, drift_metrics: Sequence[str]) -> list[float]:
        """The metrics in their order; one computation, so a decay applies once."""
        names = drift_names(drift_metrics)
        if not self.size:
            raise EmptyDatasetError("nothing was pushed since the last flush")
        self._before_compute()
        keys = list(self.shares)
        values = histogram_divergences(np.array([self.shares[k] for k in keys]), np.array([self.bins[k] for k in keys]), self.size, self.continuous, self.eps)
        return [values[m] for m in names]

    @property
    def total_samples(self) -> int:
        return int(self.size)

    @property
    def num_bins(self) -> int:
        return len(self.shares)

    def is_empty(self) -> bool:
        return self.size == 0


def histogram_divergences(p: np.ndarray, c: np.ndarray, n: float, continuous: bool, eps: float = EPS) -> dict[str, float]:
    """The drift metrics of a runtime histogram that is already on the driver; same formulas as ``operators.drift``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        base, seen, share = p + eps, (c + eps) / n, c / n + eps
        raised, mid = np.maximum(seen, eps), (base + share) / 2
        gap = np.abs(base - share)
        return {
            "PopulationStabilityIndex": float(((base - raised) * np.log(base / raised)).sum()),
            "KullbackLeibler": float((base * np.log(np.maximum(base / seen, eps))).sum()),
            "JensenShannon": float((base * np.log(base / mid) + share * np.log(share / mid)).sum() / 2 / math.log(2)),
            "WassersteinDistance": float(gap[1:-1].sum() / max(len(p) - 2, 1)) if continuous else float(gap.sum() / 2),
        }


class _Continuous(_DriftMonitor):
    continuous = True

    def __init__(self, df: DataFrame, column: str, quantile_type: QuantileType | str = QuantileType.FreedmanDiaconis, eps: float = EPS):
        self.rule = QuantileType(quantile_type)
        super().__init__(df, column, eps)

    def _fit(self, df: DataFrame) -> None:
        self.baseline = ContinuousBaseline.fit(df, self.column, self.rule)
        self.shares: dict[Any, float] = dict(enumerate(self.baseline.shares))

    def _bin(self, x: float) -> int:
        return bin_of(float(x), self.baseline.edges, self.baseline.n_bins)

    def _binned(self, df: DataFrame) -> DataFrame:
        return self.baseline.counts(df, self.column)

    def export_snapshot(self) -> dict[str, list[float]]:
        """Edges, baseline shares and runtime shares."""
        if not self.size:
            raise EmptyDatasetError("nothing was pushed since the last flush")
        return {"binEdges": list(self.baseline.edges), "baselineBins": list(self.baseline.shares), "streamBins": [self.bins[k] / self.size for k in self.shares]}

    def export_baseline(self) -> list[float]:
        return list(self.baseline.shares)


class _Categorical(_DriftMonitor):
    continuous = False

    def _fit(self, df: DataFrame) -> None:
        fitted = CategoricalBaseline.fit(df, self.column)
        self.shares = {r["label"]: r["p"] for r in fitted.labels.orderBy("label").collect()} | {_OTHER: 0.0}
        if len(self.shares) < 2:
            raise BaselineError("the baseline is empty")
        # the monitor holds the dictionary anyway: the baseline's rows are not read again
        self._labels = self.spark.createDataFrame([(k,) for k in self.shares if k is not _OTHER], "label string")

    def _bin(self, x: Any) -> str | None:
        return str(x) if str(x) in self.shares else _OTHER

    def _binned(self, df: DataFrame) -> DataFrame:
        counted = df.select(F.col(self.column).cast("string").alias("label")).groupBy("label").agg(F.count("*").alias("c"))
        known = self._labels.withColumn("known", F.col("label"))
        return counted.join(known, "label", "left").groupBy(F.col("known").alias("bin")).agg(F.sum("c").alias("c"))

    def export_snapshot(self) -> dict[str, float]:
        """Weight of each baseline label."""
        return {k: v for k, v in self.bins.items() if k is not _OTHER}

    def export_baseline(self) -> dict[str, float]:
        return {k: v for k, v in self.shares.items() if k is not _OTHER}


class _FlushMode(_DriftMonitor):
    """The window is cleared before a push once it holds ``flush_rate`` rows, or when ``flush_cadence`` seconds are over.

    After N rows the window holds the last ((N - 1) mod flush_rate) + 1, so of a batch only those are read.
    """

    def _configure(self, flush_rate: int | None, flush_cadence: int | None) -> None:
        self.flush_rate, self.flush_cadence = flush_rate or FLUSH_RATE, flush_cadence or FLUSH_CADENCE

    def flush(self) -> None:
        self._clear()

    def last_flush(self) -> int:
        """Seconds since the last flush."""
        return int(time.monotonic() - self._since)

    def _due(self) -> bool:
        return time.monotonic() - self._since >= self.flush_cadence

    def _before_push(self) -> None:
        if self.size >= self.flush_rate or (int(self.size) % CLOCK_EVERY == 0 and self._due()):
            self._clear()

    def _push(self, df: DataFrame, order: str | Column | None) -> None:
        n = df.count()
        if not n:
            return
        if self._due():
            self._clear()
        if self.size + n <= self.flush_rate:
            self._add(self._binned(df))
            return
        if order is None:
            raise ValueError("a batch that overflows the window needs an order column")
        live = (int(self.size) + n - 1) % self.flush_rate + 1
        self._clear()
        # the window that is open holds the last rows, a million perhaps: they are numbered in ranges, not sorted in one task
        rows = df.select((F.col(order) if isinstance(order, str) else order).alias("_order"), self.column)
        self._add(self._binned(number_rows(rows, ["_order"], name="_number").where(F.col("_number") >= n - live)))


class _DecayMode(_DriftMonitor):
    """Every computation first multiplies the histogram and its size by 0.5 ** (1 / half_life)."""

    def _configure_decay(self, half_life: int | None) -> None:
        self.decay = 0.5 ** (1.0 / (half_life or DECAY_HALF_LIFE))

    def _before_compute(self) -> None:
        self.bins = {k: v * self.decay for k, v in self.bins.items()}
        self.size *= self.decay


class StreamingContinuousDataDriftFlush(_FlushMode, _Continuous):
    def __init__(self, df: DataFrame, column: str, quantile_type: QuantileType | str = QuantileType.FreedmanDiaconis, flush_rate: int | None = None, flush_cadence: int | None = None, eps: float = EPS):
        self._configure(flush_rate, flush_cadence)
        _Continuous.__init__(self, df, column, quantile_type, eps)


class StreamingContinuousDataDriftDecay(_DecayMode, _Continuous):
    def __init__(self, df: DataFrame, column: str, quantile_type: QuantileType | str = QuantileType.FreedmanDiaconis, decay_half_life: int | None = None, eps: float = EPS):
        self._configure_decay(decay_half_life)
        _Continuous.__init__(self, df, column, quantile_type, eps)


class StreamingCategoricalDataDriftFlush(_FlushMode, _Categorical):
    def __init__(self, df: DataFrame, column: str, flush_rate: int | None = None, flush_cadence: int | None = None, eps: float = EPS):
        self._configure(flush_rate, flush_cadence)
        _Categorical.__init__(self, df, column, eps)


class StreamingCategoricalDataDriftDecay(_DecayMode, _Categorical):
    def __init__(self, df: DataFrame, column: str, decay_half_life: int | None = None, eps: float = EPS):
        self._configure_decay(decay_half_life)
        _Categorical.__init__(self, df, column, eps)
