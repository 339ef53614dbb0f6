"""Batch analyses: label, one aggregate, closed forms. Each is lazy and takes optional group columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import cells
from gaugeline.functions.finishers import FINISHERS
from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS, ModelType
from gaugeline.functions.segments import LabeledSegment, Payload, Segment
from gaugeline.operators.reports import to_long

BINARY, LOGISTIC, LINEAR = (m.value for m in (ModelType.BinaryClassification, ModelType.LogisticRegression, ModelType.LinearRegression))


def _used(df: DataFrame, columns: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Only the columns in use, without rows where one of them is null."""
    named = [c.alias(f"_u{i}") for i, c in enumerate(columns)]
    rows = df.select(*by, *named)
    for i in range(len(columns)):
        rows = rows.where(F.col(f"_u{i}").isNotNull())
    return rows


def _u(i: int) -> Column:
    return F.col(f"_u{i}")


def facet_counts(df: DataFrame, facet: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """n_a, pos_a, n_d, pos_d by group."""
    return _used(df, [facet, label], by).groupBy(*by).agg(*cells.facet_cells(_u(0), _u(1)))


def model_counts(df: DataFrame, facet: Column, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """The confusion matrix of either facet by group: eight counts, one pass."""
    return _used(df, [facet, truth, pred], by).groupBy(*by).agg(*cells.model_cells(_u(0), _u(1), _u(2)))


def confusion_counts(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    return _used(df, [truth, pred], by).groupBy(*by).agg(*cells.confusion_cells(_u(0), _u(1)))


def logistic_counts(df: DataFrame, truth: Column, prob: Column, positive: Column, threshold: float, by: Sequence[str] = (), eps: float = cells.EPS) -> DataFrame:
    """Confusion counts of ``prob >= threshold`` against ``positive``, and the log penalty of ``prob`` for ``truth``."""
    rows = _used(df, [truth, prob, positive], by)
    guess = _u(1).cast("double")
    return rows.groupBy(*by).agg(*cells.confusion_cells(_u(2), ~F.isnan(guess) & (guess >= threshold)), cells.log_penalty(_u(0), _u(1), eps))


def regression_sums(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    return _used(df, [truth, pred], by).groupBy(*by).agg(*cells.regression_cells(_u(0), _u(1)))


def finish(counted: DataFrame, family: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, value) from a table of cells."""
    return to_long(counted, FINISHERS[family](), by)


def boolean(df: DataFrame, column: str, criterion: Segment | Payload | Column) -> Column:
    """The Boolean column of a criterion applied to a column."""
    if isinstance(criterion, Column):
        return criterion
    if isinstance(criterion, Payload):
        return criterion.resolve(df)
    return Payload(column, criterion).resolve(df)


def data_bias_report(df: DataFrame, feature: str, ground_truth: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, by: Sequence[str] = ()) -> DataFrame:
    """The seven pre-training metrics; rows with a null feature or truth are left out."""
    return finish(facet_counts(df, boolean(df, feature, feature_segment), boolean(df, ground_truth, ground_truth_segment), by), DATA_BIAS, by)


def model_bias_report(
    df: DataFrame, feature: str, ground_truth: str, prediction: str, feature_segment: Segment | Column, ground_truth_segment: Segment | Column, prediction_segment: Segment | Column, by: Sequence[str] = (), adhoc: bool = False
) -> DataFrame:
    """The twelve post-training metrics, of the suite or of the stand-alone variants."""
    counted = model_counts(df, boolean(df, feature, feature_segment), boolean(df, ground_truth, ground_truth_segment), boolean(df, prediction, prediction_segment), by)
    return finish(counted, "model_bias_adhoc" if adhoc else MODEL_BIAS, by)


def binary_report(df: DataFrame, y_true: str, y_pred: str, label: Any = 1, by: Sequence[str] = ()) -> DataFrame:
    """Classification metrics with ``label`` as the positive class; any type that compares for equality."""
    one = LabeledSegment(label)
    return finish(confusion_counts(df, one.column(F.col(y_true)), one.column(F.col(y_pred)), by), BINARY, by)


def logistic_report(df: DataFrame, y_true: str, y_pred: str, threshold: float = 0.5, by: Sequence[str] = (), exact_truth: bool = False, eps: float = cells.EPS) -> DataFrame:
    """Classification metrics of probabilities, and log loss.

    The batch form applies the threshold to y_true as well; with ``exact_truth`` (the monitors' form) y_true is positive
    where it is 1. Both agree for labels 0 and 1 and thresholds in (0, 1].
    """
    t = F.col(y_true).cast("double")
    positive = (t == 1.0) if exact_truth else ~F.isnan(t) & (t >= threshold)
    return finish(logistic_counts(df, F.col(y_true), F.col(y_pred), positive, threshold, by, eps), LOGISTIC, by)


def linear_report(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    return finish(regression_sums(df, F.col(y_true), F.col(y_pred), by), LINEAR, by)


def linear_adhoc_report(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """The stand-alone variants: percentage errors keep the sign of y_true, and R squared has no guard for a constant y_true."""
    from gaugeline.functions import finishers, ieee

    rows = _used(df, [F.col(y_true), F.col(y_pred)], by)
    signed = F.sum(ieee.div(F.abs(_u(1).cast("double") - _u(0).cast("double")), _u(0).cast("double"))).alias("sum_signed")
    counted = rows.groupBy(*by).agg(*cells.regression_cells(_u(0), _u(1)), signed)
    metrics = finishers.linear()
    sse = F.col("sum_t2") - 2 * F.col("sum_tp") + F.col("sum_p2")
    sst = F.col("sum_t2") - ieee.div(F.col("sum_t") * F.col("sum_t"), F.col("n"))
    metrics["RSquared"] = 1 - ieee.div(sse, sst)
    metrics["MeanAbsolutePercentageError"] = ieee.div(F.col("sum_signed"), F.col("n"))
    return to_long(counted, metrics, by)


def multiclass_accuracy(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the truth, for labels of any type."""
    rows = _used(df, [F.col(y_true), F.col(y_pred)], by)
    hit = F.count_if(_u(0) == _u(1)).cast("double")
    return to_long(rows.groupBy(*by).agg(hit.alias("hits"), F.count("*").cast("double").alias("n")), {"Accuracy": F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(float("nan")))}, by)
