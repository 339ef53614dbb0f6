"""Closed forms from cell columns to metric columns; batch, grouped, windowed and monitor paths share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions.ieee import div, larger, ln, nan, sqrt
from gaugeline.functions.metrics import ModelType

Metrics = dict[str, Column]


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _bernoulli_kl(p: Column, q: Column) -> Column:
    return p * ln(div(p, q)) + (1 - p) * ln(div(1 - p, 1 - q))


def data_bias() -> Metrics:
    n_a, n_d = _c("n_a"), _c("n_d")
    p, q = div(_c("pos_a"), n_a), div(_c("pos_d"), n_d)
    mid = (p + q) / 2
    up, down = p - q, (1 - p) - (1 - q)
    return {
        "ClassImbalance": div(F.abs(n_a - n_d), n_a + n_d),
        "DifferenceInProportionOfLabels": p - q,
        "KlDivergence": _bernoulli_kl(p, q),
        "JsDivergence": (_bernoulli_kl(p, mid) + _bernoulli_kl(q, mid)) / 2,
        "LpNorm": sqrt(up * up + down * down),
        "TotalVariationDistance": (F.abs(up) + F.abs(down)) / 2,
        "KolmogorovSmirnov": larger(F.abs(down), F.abs(up)),
    }


def _facet(f: str) -> dict[str, Column]:
    x = {c: _c(f"{f}_{c}") for c in ("tp", "fp", "tn", "fn")}
    x["n"] = x["tp"] + x["fp"] + x["tn"] + x["fn"]
    x["pp"], x["pg"] = x["tp"] + x["fp"], x["tp"] + x["fn"]
    return x


def _benefits() -> tuple[Column, Column, Column]:
    """Rows with benefit 0 (missed), 1 (granted rightly) and 2 (all others)."""
    a, d = _facet("a"), _facet("d")
    return a["fn"] + d["fn"], a["tp"] + d["tp"], a["fp"] + d["fp"] + a["tn"] + d["tn"]


def _entropy() -> Column:
    """Sum over rows of (benefit / mean benefit)^2 - 1, from the counts of the three benefits."""
    zero, one, two = _benefits()
    n, first, second = zero + one + two, one + 2 * two, one + 4 * two
    return div(n * n * second, first * first) - n


def model_bias() -> Metrics:
    """The suite that reports and monitors use."""
    a, d = _facet("a"), _facet("d")
    rate = lambda f: div(f["pp"], f["n"])
    # the weighted terms cancel to 0 wherever both facets have predicted positives and negatives
    defined = (a["pp"] > 0) & (d["pp"] > 0) & (a["n"] > a["pp"]) & (d["n"] > d["pp"])
    return {
        "DifferenceInPositivePredictedLabels": rate(a) - rate(d),
        "DisparateImpact": div(rate(a), rate(d)),
        "AccuracyDifference": div(a["tp"] + a["tn"], a["n"]) - div(d["tp"] + d["tn"], d["n"]),
        "RecallDifference": div(a["tp"], a["pg"]) - div(d["tp"], d["pg"]),
        "DifferenceInConditionalAcceptance": div(a["pp"], a["pg"]) - div(d["pp"], d["pg"]),
        "DifferenceInAcceptanceRate": div(a["tp"], a["pp"]) - div(d["tp"], d["pp"]),
        "SpecialityDifference": div(a["tn"], a["tn"] + a["fp"]) - div(d["tn"], d["tn"] + d["fp"]),
        "DifferenceInConditionalRejection": div(d["n"] - d["pg"], d["n"] - d["pp"]) - div(a["n"] - a["pg"], a["n"] - a["pp"]),
        "DifferenceInRejectionRate": div(d["tn"], d["tn"] + d["fn"]) - div(a["tn"], a["tn"] + a["fn"]),
        "TreatmentEquity": div(d["fn"], d["fp"]) - div(a["fn"], a["fp"]),
        "ConditionalDemographicDesparityPredictedLabels": F.when(defined, F.lit(0.0)).otherwise(nan()),
        "GeneralizedEntropy": _entropy(),
    }


def model_bias_adhoc() -> Metrics:
    """The stand-alone variants, which differ from the suite in normalisation or sign."""
    a, d = _facet("a"), _facet("d")
    positives, negatives = a["pp"] + d["pp"], (a["n"] - a["pp"]) + (d["n"] - d["pp"])
    q_d = div(d["pp"], d["pg"])
    n = a["n"] + d["n"]
    suite = model_bias()
    return {
        "DifferenceInPositivePredictedLabels": div(a["pp"], a["pg"]) - q_d,
        "DisparateImpact": F.when(q_d == 0, F.lit(0.0)).otherwise(div(div(a["pp"], d["pg"]), q_d)),
        "AccuracyDifference": suite["AccuracyDifference"],
        "RecallDifference": suite["RecallDifference"],
        "DifferenceInConditionalAcceptance": div(a["pg"], a["pp"]) - div(d["pg"], d["pp"]),
        "DifferenceInAcceptanceRate": div(a["tp"], a["tp"] + d["fp"]) - div(d["tp"], d["pp"]),
        "SpecialityDifference": -suite["SpecialityDifference"],
        "DifferenceInConditionalRejection": suite["DifferenceInConditionalRejection"],
        "DifferenceInRejectionRate": suite["DifferenceInRejectionRate"],
        "TreatmentEquity": suite["TreatmentEquity"],
        "ConditionalDemographicDesparityPredictedLabels": div(d["n"] - d["pp"], negatives) - div(d["pp"], positives),
        "GeneralizedEntropy": _entropy() * n / 2,
    }


def classification() -> Metrics:
    tp, fp, tn, fn = (_c(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return {
        "BalancedAccuracy": (recall + specificity) / 2,
        "PrecisionPositive": precision,
        "PrecisionNegative": div(tn, tn + fn),
        "RecallPositive": recall,
        "RecallNegative": specificity,
        "Accuracy": div(tp + tn, tp + fp + tn + fn),
        "F1Score": div(2 * recall * precision, recall + precision),
    }


def logistic() -> Metrics:
    return classification() | {"LogLoss": div(-_c("penalty"), _c("tp") + _c("fp") + _c("tn") + _c("fn"))}


def linear() -> Metrics:
    n = _c("n")
    sse = _c("sum_t2") - 2 * _c("sum_tp") + _c("sum_p2")
    sst = _c("sum_t2") - div(_c("sum_t") * _c("sum_t"), n)
    mse, msle = div(_c("sum_e2"), n), div(_c("sum_log2"), n)
    return {
        "RootMeanSquaredError": sqrt(mse),
        "MeanSquaredError": mse,
        "MeanAbsoluteError": div(_c("sum_abs"), n),
        "RSquared": F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - div(sse, sst)),
        "MaxError": _c("max_abs"),
        "MeanSquaredLogError": msle,
        "RootMeanSquaredLogError": sqrt(msle),
        "MeanAbsolutePercentageError": div(_c("sum_ape"), n),
    }


FINISHERS = {
    "data_bias": data_bias,
    "model_bias": model_bias,
    "model_bias_adhoc": model_bias_adhoc,
    ModelType.BinaryClassification.value: classification,
    ModelType.LogisticRegression.value: logistic,
    ModelType.LinearRegression.value: linear,
}
