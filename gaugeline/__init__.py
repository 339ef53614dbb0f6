"""Spark-first analytics for data bias, model bias, model performance and drift."""

from gaugeline.functions.metrics import ClassificationMetric, DataBiasMetric, DataDriftMetric, LinearRegressionMetric, ModelBiasMetric, ModelType
from gaugeline.functions.segments import ColumnSegment, LabeledSegment, Payload, SegmentationType, ThresholdSegment, ThresholdType, segment
from gaugeline.operators.api import (
    adhoc_classification_metric,
    adhoc_metric,
    adhoc_regression_metric,
    binary_classification_analysis,
    data_bias_partial_runtime_comparison,
    data_bias_perform_analysis,
    data_bias_perform_analysis_explicit_segmentation,
    data_bias_runtime_comparison,
    linear_regression_analysis,
    logistic_regression_analysis,
    model_bias_partial_runtime_comparison,
    model_bias_perform_analysis,
    model_bias_perform_analysis_explicit_segmentation,
    model_bias_runtime_comparison,
    partial_runtime_check,
    runtime_check_full,
)
from gaugeline.operators.drift import CategoricalDataDrift, ContinuousDataDrift, QuantileType, compute_drift_categorical_distribution, compute_drift_continuous_distribution
from gaugeline.streaming.monitors import (
    BinaryClassificationStreaming,
    DataBiasStreaming,
    LinearRegressionStreaming,
    LogisticRegressionStreaming,
    ModelBiasStreaming,
    StreamingCategoricalDataDriftDecay,
    StreamingCategoricalDataDriftFlush,
    StreamingContinuousDataDriftDecay,
    StreamingContinuousDataDriftFlush,
)

__all__ = [name for name in dir() if name[0] != "_" and name not in ("functions", "operators", "streaming", "sources", "plans", "errors")]
