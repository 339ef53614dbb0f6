"""Metric names by family; a metric's value is its name."""

from __future__ import annotations

from collections.abc import Iterable
from enum import StrEnum

from gaugeline.errors import InvalidMetricError


class DataBiasMetric(StrEnum):
    ClassImbalance = "ClassImbalance"
    DifferenceInProportionOfLabels = "DifferenceInProportionOfLabels"
    KlDivergence = "KlDivergence"
    JsDivergence = "JsDivergence"
    LpNorm = "LpNorm"
    TotalVariationDistance = "TotalVariationDistance"
    KolmogorovSmirnov = "KolmogorovSmirnov"


class ModelBiasMetric(StrEnum):
    DifferenceInPositivePredictedLabels = "DifferenceInPositivePredictedLabels"
    DisparateImpact = "DisparateImpact"
    AccuracyDifference = "AccuracyDifference"
    RecallDifference = "RecallDifference"
    DifferenceInConditionalAcceptance = "DifferenceInConditionalAcceptance"
    DifferenceInAcceptanceRate = "DifferenceInAcceptanceRate"
    SpecialityDifference = "SpecialityDifference"
    DifferenceInConditionalRejection = "DifferenceInConditionalRejection"
    DifferenceInRejectionRate = "DifferenceInRejectionRate"
    TreatmentEquity = "TreatmentEquity"
    ConditionalDemographicDesparityPredictedLabels = "ConditionalDemographicDesparityPredictedLabels"
    GeneralizedEntropy = "GeneralizedEntropy"


class ClassificationMetric(StrEnum):
    BalancedAccuracy = "BalancedAccuracy"
    PrecisionPositive = "PrecisionPositive"
    PrecisionNegative = "PrecisionNegative"
    RecallPositive = "RecallPositive"
    RecallNegative = "RecallNegative"
    Accuracy = "Accuracy"
    F1Score = "F1Score"
    LogLoss = "LogLoss"


class LinearRegressionMetric(StrEnum):
    RootMeanSquaredError = "RootMeanSquaredError"
    MeanSquaredError = "MeanSquaredError"
    MeanAbsoluteError = "MeanAbsoluteError"
    RSquared = "RSquared"
    MaxError = "MaxError"
    MeanSquaredLogError = "MeanSquaredLogError"
    RootMeanSquaredLogError = "RootMeanSquaredLogError"
    MeanAbsolutePercentageError = "MeanAbsolutePercentageError"


class DataDriftMetric(StrEnum):
    PopulationStabilityIndex = "PopulationStabilityIndex"
    KullbackLeibler = "KullbackLeibler"
    JensenShannon = "JensenShannon"
    WassersteinDistance = "WassersteinDistance"


class ModelType(StrEnum):
    LinearRegression = "LinearRegression"
    LogisticRegression = "LogisticRegression"
    BinaryClassification = "BinaryClassification"


DATA_BIAS, MODEL_BIAS = "data_bias", "model_bias"

#: Metrics of each report family.
FAMILIES: dict[str, tuple[str, ...]] = {
    DATA_BIAS: tuple(m.value for m in DataBiasMetric),
    MODEL_BIAS: tuple(m.value for m in ModelBiasMetric),
    ModelType.BinaryClassification.value: tuple(m.value for m in ClassificationMetric if m is not ClassificationMetric.LogLoss),
    ModelType.LogisticRegression.value: tuple(m.value for m in ClassificationMetric),
    ModelType.LinearRegression.value: tuple(m.value for m in LinearRegressionMetric),
}


def metric_names(family: str, wanted: Iterable[str] | None = None) -> tuple[str, ...]:
    """The names of a family, or the wanted ones after a check; order of the family, repeats dropped."""
    known = FAMILIES[family]
    if wanted is None:
        return known
    asked = [str(getattr(m, "value", m)) for m in wanted]
    if bad := [m for m in asked if m not in known]:
        raise InvalidMetricError(f"not a {family} metric: {', '.join(bad)}")
    return tuple(m for m in known if m in asked)


def drift_names(wanted: Iterable[str] | None = None) -> tuple[str, ...]:
    """Drift metric names in the order asked for; all of them without a wish."""
    known = tuple(m.value for m in DataDriftMetric)
    if wanted is None:
        return known
    asked = tuple(str(getattr(m, "value", m)) for m in wanted)
    if bad := [m for m in asked if m not in known]:
        raise InvalidMetricError(f"not a drift metric: {', '.join(bad)}")
    return asked
