"""Eager entry points: they run one job, return plain dictionaries and raise typed errors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.errors import EmptyDatasetError, FacetError, InvalidMetricError, InvalidReportError, ModelTypeMismatchError
from gaugeline.functions.cells import EPS
from gaugeline.functions.finishers import FINISHERS
from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS, ModelType
from gaugeline.functions.segments import DISTINCT_SHARE, LabeledSegment, Segment, heuristic_segments
from gaugeline.operators import analysis
from gaugeline.operators.reports import THRESHOLD, drift_report_dict, report_from_dict, runtime_check, to_long
from gaugeline.sources.tables import performance_report, require_numeric

BINARY, LOGISTIC, LINEAR = analysis.BINARY, analysis.LOGISTIC, analysis.LINEAR


def check_cells(cells: Mapping[str, float], family: str) -> None:
    """Raises where a family's metrics are not defined for these cells."""
    if family == DATA_BIAS:
        if cells["n_a"] + cells["n_d"] == 0:
            raise EmptyDatasetError("no rows")
        if not cells["n_a"] or not cells["n_d"]:
            raise FacetError("a facet has no rows")
    elif family == MODEL_BIAS:
        n = {f: sum(cells[f"{f}_{c}"] for c in ("tp", "fp", "tn", "fn")) for f in ("a", "d")}
        if not n["a"] and not n["d"]:
            raise EmptyDatasetError("no rows")
        for f in ("a", "d"):
            tp, fp, tn, fn = (cells[f"{f}_{c}"] for c in ("tp", "fp", "tn", "fn"))
            if not n[f]:
                raise EmptyDatasetError(f"facet {f} has no rows")
            for bad, what in ((tp + fn == 0, "positive truths"), (tn + fn == 0, "negative predictions"), (fp == 0, "false positives")):
                if bad:
                    raise FacetError(f"facet {f} has no {what}")
        if not cells["d_tp"] + cells["d_fp"]:
            raise FacetError("facet d has no positive predictions")
    elif not sum(cells[c] for c in (("n",) if family == LINEAR else ("tp", "fp", "tn", "fn"))):
        raise EmptyDatasetError("no rows")


def _analysed(counted: DataFrame, family: str) -> dict[str, float]:
    metrics = FINISHERS[family]()
    row = counted.select("*", *[c.cast("double").alias(f"_m_{m}") for m, c in metrics.items()]).first().asDict()
    check_cells(row, family)
    return {m: row[f"_m_{m}"] for m in metrics}


def data_bias_perform_analysis(df: DataFrame, feature: str, ground_truth: str, feature_label_or_threshold: Any, ground_truth_label_or_threshold: Any, share: float = DISTINCT_SHARE) -> dict[str, float]:
    """Metrics with criteria implied by bare labels or thresholds; share: of distinct values, up to which a number is a label."""
    facet, truth = heuristic_segments(df, [(feature, feature_label_or_threshold), (ground_truth, ground_truth_label_or_threshold)], share)
    return _analysed(analysis.facet_counts(df, facet, truth), DATA_BIAS)


def data_bias_perform_analysis_explicit_segmentation(df: DataFrame, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column) -> dict[str, float]:
    return _analysed(analysis.facet_counts(df, analysis.boolean(df, feature, feature_segment), analysis.boolean(df, ground_truth, ground_truth_segment)), DATA_BIAS)


def model_bias_perform_analysis(
    df: DataFrame, feature: str, ground_truth: str, predictions: str, feature_label_or_threshold: Any, ground_truth_label_or_threshold: Any, prediction_label_or_threshold: Any, share: float = DISTINCT_SHARE
) -> dict[str, float]:
    sides = heuristic_segments(df, [(feature, feature_label_or_threshold), (ground_truth, ground_truth_label_or_threshold), (predictions, prediction_label_or_threshold)], share)
    return _analysed(analysis.model_counts(df, *sides), MODEL_BIAS)


def model_bias_perform_analysis_explicit_segmentation(
    df: DataFrame, feature: str, ground_truth: str, prediction: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction_segment: Segment | Column
) -> dict[str, float]:
    sides = [analysis.boolean(df, c, s) for c, s in ((feature, feature_segment), (ground_truth, ground_truth_segment), (prediction, prediction_segment))]
    return _analysed(analysis.model_counts(df, *sides), MODEL_BIAS)


def linear_regression_analysis(df: DataFrame, y_true: str, y_pred: str) -> dict:
    df = require_numeric(df.select(y_true, y_pred), y_true, y_pred)
    return performance_report(LINEAR, _analysed(analysis.regression_sums(df, F.col(y_true), F.col(y_pred)), LINEAR))


def logistic_regression_analysis(df: DataFrame, y_true: str, y_pred: str, decision_threshold: float = 0.5, eps: float = EPS) -> dict:
    df = require_numeric(df.select(y_true, y_pred), y_true, y_pred)
    t = F.col(y_true)
    values = _analysed(analysis.logistic_counts(df, t, F.col(y_pred), ~F.isnan(t) & (t >= decision_threshold), decision_threshold, eps=eps), LOGISTIC)
    if math.isnan(values["LogLoss"]):
        raise FacetError("log loss is not defined")
    return performance_report(LOGISTIC, values)


def binary_classification_analysis(df: DataFrame, y_true: str, y_pred: str, label: Any = 1) -> dict:
    one = LabeledSegment(label)
    return performance_report(BINARY, _analysed(analysis.confusion_counts(df, one.column(F.col(y_true)), one.column(F.col(y_pred))), BINARY))


def _compared(spark: SparkSession, latest: Mapping[str, float], baseline: Mapping[str, float], family: str, threshold: float, metrics: Iterable[str] | None) -> dict:
    tables = [report_from_dict(spark, x, family) for x in (latest, baseline)]
    return drift_report_dict(runtime_check(*tables, family, threshold, metrics))


def data_bias_runtime_comparison(spark: SparkSession, baseline: Mapping[str, float], latest: Mapping[str, float], threshold: float = THRESHOLD) -> dict:
    return _compared(spark, latest, baseline, DATA_BIAS, threshold, None)


def data_bias_partial_runtime_comparison(spark: SparkSession, baseline: Mapping[str, float], latest: Mapping[str, float], metrics: Iterable[str], threshold: float = THRESHOLD) -> dict:
    return _compared(spark, latest, baseline, DATA_BIAS, threshold, metrics)


def model_bias_runtime_comparison(spark: SparkSession, baseline: Mapping[str, float], comparison: Mapping[str, float], threshold: float = THRESHOLD) -> dict:
    return _compared(spark, comparison, baseline, MODEL_BIAS, threshold, None)


def model_bias_partial_runtime_comparison(spark: SparkSession, baseline: Mapping[str, float], comparison: Mapping[str, float], metrics: Iterable[str], threshold: float = THRESHOLD) -> dict:
    return _compared(spark, comparison, baseline, MODEL_BIAS, threshold, metrics)


def _tagged(report: Mapping[str, Any]) -> tuple[str, Mapping[str, float]]:
    try:
        kind, data = str(ModelType(report["model_type"]).value), report["performance_data"]
    except (KeyError, TypeError, ValueError):
        raise InvalidReportError("a performance report needs model_type and performance_data") from None
    performance_report(kind, data)
    return kind, data


def runtime_check_full(spark: SparkSession, latest: Mapping[str, Any], baseline: Mapping[str, Any], threshold: float = THRESHOLD, metrics: Iterable[str] | None = None) -> dict:
    """Compares two tagged performance reports of one model type; the latest comes first."""
    (kind, new), (other, old) = _tagged(latest), _tagged(baseline)
    if kind != other:
        raise ModelTypeMismatchError(f"{kind} against {other}")
    return _compared(spark, new, old, kind, threshold, metrics)


def partial_runtime_check(spark: SparkSession, latest: Mapping[str, Any], baseline: Mapping[str, Any], metrics: Iterable[str], threshold: float = THRESHOLD) -> dict:
    wanted = list(metrics)
    if not wanted:
        raise InvalidMetricError("no metrics given")
    return runtime_check_full(spark, latest, baseline, threshold, wanted)


def adhoc_metric(df: DataFrame, metric: str, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction: str | None = None, prediction_segment: Segment | Column | None = None) -> float:
    """One stand-alone bias metric: data bias without a prediction, else the stand-alone model bias variant."""
    f, g = analysis.boolean(df, feature, feature_segment), analysis.boolean(df, ground_truth, ground_truth_segment)
    if prediction is None:
        counted, family = analysis.facet_counts(df, f, g), DATA_BIAS
    else:
        counted, family = analysis.model_counts(df, f, g, analysis.boolean(df, prediction, prediction_segment)), "model_bias_adhoc"
    name = str(getattr(metric, "value", metric))
    if name not in FINISHERS[family]():
        raise InvalidMetricError(f"unknown metric {name!r}")
    row = to_long(counted, {name: FINISHERS[family]()[name]}).first()
    return row["value"]


def adhoc_classification_metric(df: DataFrame, metric: str, y_true: str, y_pred: str, label: Any = None, threshold: float | None = None) -> float:
    """One classification metric, with a positive ``label`` or a decision ``threshold`` for both columns.

    Accuracy with a label is the share of rows whose label agrees, whatever the label is; log loss needs neither.
    """
    name = str(getattr(metric, "value", metric))
    if name not in FINISHERS[LOGISTIC]():
        raise InvalidMetricError(f"unknown metric {name!r}")
    if name == "Accuracy" and threshold is None:
        return analysis.multiclass_accuracy(df, y_true, y_pred).first()["value"]
    if name == "LogLoss" or threshold is not None:
        df = require_numeric(df.select(y_true, y_pred), y_true, y_pred)
        cut = 0.5 if threshold is None else threshold
        counted = analysis.logistic_counts(df, F.col(y_true), F.col(y_pred), ~F.isnan(y_true) & (F.col(y_true) >= cut), cut)
    else:
        one = LabeledSegment(label)
        counted = analysis.confusion_counts(df, one.column(F.col(y_true)), one.column(F.col(y_pred)))
    return to_long(counted, {name: FINISHERS[LOGISTIC]()[name]}).first()["value"]


def adhoc_regression_metric(df: DataFrame, metric: str, y_true: str, y_pred: str) -> float:
    """One regression metric of the stand-alone variants; the mean squared log error raises where a value is -1."""
    name = str(getattr(metric, "value", metric))
    if name not in FINISHERS[LINEAR]():
        raise InvalidMetricError(f"unknown metric {name!r}")
    df = require_numeric(df.select(y_true, y_pred), y_true, y_pred)
    if name == "MeanSquaredLogError" and df.where((F.col(y_true) == -1) | (F.col(y_pred) == -1)).limit(1).count():
        raise FacetError("the log error is not defined at -1")
    rows = analysis.linear_adhoc_report(df, y_true, y_pred).where(F.col("metric") == name).collect()
    value = rows[0]["value"]
    if df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).limit(1).count() == 0:
        raise EmptyDatasetError("no rows")
    return value
