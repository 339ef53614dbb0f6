import pytest

from gaugeline.errors import EmptyDatasetError, InvalidReportError, ModelTypeMismatchError
from gaugeline.functions.metrics import FAMILIES, ModelType
from gaugeline.operators import analysis, api, reports
from gaugeline.sources.tables import from_columns

T = [11.0, 12.5, 14.0, 11.7, 15.1, 15.4, 13.2, 11.5, 11.6]
P = [11.1, 12.2, 13.4, 10.7, 15.8, 16.3, 14.5, 12.3, 11.0]
LABELS = [0, 0, 1, 1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1]
GUESSES = [1, 0, 1, 1, 0, 0, 0, 1, 0, 1, 0, 0, 1, 1, 0, 1]
PROBS = [0.7, 0.3, 0.65, 0.55, 0.1, 0.2, 0.25, 0.66, 0.12, 0.98, 0.23, 0.34, 0.67, 0.77, 0.45, 0.88]
CLASSES = {"PrecisionPositive": 0.75, "PrecisionNegative": 0.625, "RecallPositive": 2 / 3, "RecallNegative": 0.714286, "F1Score": 0.705882, "Accuracy": 0.6875, "BalancedAccuracy": 0.690476}


def test_linear(spark):
    got = api.linear_regression_analysis(from_columns(spark, t=T, p=P), "t", "p")
    assert got["model_type"] == "LinearRegression"
    want = {
        "RootMeanSquaredError": 0.778174502, "MeanSquaredError": 0.605555556, "MeanAbsoluteError": 0.7, "RSquared": 0.743516001, "MaxError": 1.3,
        "MeanSquaredLogError": 0.003059372, "RootMeanSquaredLogError": 0.055311593, "MeanAbsolutePercentageError": 0.053999057,
    }
    assert got["performance_data"] == pytest.approx(want, abs=1e-8)


def test_linear_edges(spark):
    got = api.linear_regression_analysis(from_columns(spark, t=[1, 2, 3, 4, 5], p=[2, 3, 4, 5, 6]), "t", "p")["performance_data"]
    assert (got["MeanSquaredError"], got["RSquared"]) == (1, 0.5)
    constant = from_columns(spark, t=[2.0, 2.0], p=[2.0, 2.0])
    assert api.linear_regression_analysis(constant, "t", "p")["performance_data"]["RSquared"] == 1
    off = from_columns(spark, t=[2.0, 2.0], p=[3.0, 2.0])
    assert api.linear_regression_analysis(off, "t", "p")["performance_data"]["RSquared"] == 0
    negative = from_columns(spark, t=[-2.0, 4.0], p=[-1.0, 4.0])
    assert reports.report_to_dict(analysis.linear_adhoc_report(negative, "t", "p"))["MeanAbsolutePercentageError"] == pytest.approx(-0.25)
    with pytest.raises(TypeError):
        api.linear_regression_analysis(from_columns(spark, t=["a"], p=[1.0]), "t", "p")
    with pytest.raises(EmptyDatasetError):
        api.linear_regression_analysis(constant.limit(0), "t", "p")


def test_binary(spark):
    got = api.binary_classification_analysis(from_columns(spark, t=LABELS, p=GUESSES), "t", "p")
    assert got["performance_data"] == pytest.approx(CLASSES, abs=1e-6)
    words = from_columns(spark, t=["yes" if x else "no" for x in LABELS], p=["yes" if x else "no" for x in GUESSES])
    assert api.binary_classification_analysis(words, "t", "p", "yes") == got


def test_logistic(spark):
    df = from_columns(spark, t=[float(x) for x in LABELS], p=PROBS)
    got = api.logistic_regression_analysis(df, "t", "p")["performance_data"]
    assert got == pytest.approx(CLASSES | {"LogLoss": 0.714502180}, abs=1e-6)
    assert api.logistic_regression_analysis(df, "t", "p", 0.9)["performance_data"]["PrecisionPositive"] == 1


def test_logistic_certain_probabilities(spark):
    df = from_columns(spark, t=[1.0, 0.0, 1.0], p=[1.0, 0.0, 0.5])
    assert api.logistic_regression_analysis(df, "t", "p")["performance_data"]["LogLoss"] == pytest.approx(0.231049, abs=1e-6)


def test_multiclass(spark):
    df = from_columns(spark, t=["a", "b", "c", "a"], p=["a", "c", "c", "b"])
    assert reports.report_to_dict(analysis.multiclass_accuracy(df, "t", "p")) == {"Accuracy": 0.5}


@pytest.mark.parametrize(("kind", "metric", "base", "late", "fails"), [
    ("LinearRegression", "RSquared", 0.95, 0.5, True), ("LinearRegression", "RSquared", 0.5, 0.95, False), ("LinearRegression", "MaxError", 1.0, 1.2, True),
    ("LogisticRegression", "LogLoss", 0.2, 0.5, True), ("LogisticRegression", "LogLoss", 0.5, 0.1, False), ("LogisticRegression", "Accuracy", 0.9, 0.8, True),
    ("BinaryClassification", "Accuracy", 0.9, 0.8, True), ("BinaryClassification", "Accuracy", 0.9, 0.82, False),
])
def test_runtime_checks(spark, kind, metric, base, late, fails):
    same = dict.fromkeys(FAMILIES[kind], 0.5)
    old, new = ({"model_type": kind, "performance_data": same | {metric: v}} for v in (base, late))
    got = api.runtime_check_full(spark, new, old)
    assert got["passed"] is not fails
    if fails:
        assert got["failed_report"] == [{"metric": metric, "drift": pytest.approx(abs(base - late))}]
    assert api.partial_runtime_check(spark, new, old, [metric])["passed"] is not fails


def test_report_validation(spark):
    a = {"model_type": "LinearRegression", "performance_data": dict.fromkeys(FAMILIES["LinearRegression"], 0.1)}
    b = {"model_type": "BinaryClassification", "performance_data": dict.fromkeys(FAMILIES["BinaryClassification"], 0.1)}
    with pytest.raises(ModelTypeMismatchError):
        api.runtime_check_full(spark, a, b)
    for bad in ({}, {"model_type": "Other", "performance_data": {}}, a | {"performance_data": {"MaxError": 1.0}}, a | {"performance_data": a["performance_data"] | {"More": 1.0}}):
        with pytest.raises(InvalidReportError):
            api.runtime_check_full(spark, bad, a)


def test_snapshots(spark):
    names = FAMILIES[ModelType.LogisticRegression.value]
    tables = [reports.report_from_dict(spark, dict.fromkeys(names, v), "LogisticRegression") for v in (0.3, 0.5)]
    assert set(reports.report_to_dict(reports.drift_snapshot(*tables, "LogisticRegression")).values()) == {0.2}
    linear = [reports.report_from_dict(spark, dict.fromkeys(FAMILIES["LinearRegression"], v), "LinearRegression") for v in (0.5, 0.25)]
    assert set(reports.report_to_dict(reports.drift_snapshot(*linear, "LinearRegression")).values()) == {0.25}


def test_report_round_trip(spark, tmp_path):
    from gaugeline.sources.tables import read_report, write_report

    report = reports.report_from_dict(spark, dict.fromkeys(FAMILIES["LinearRegression"], 0.5), "LinearRegression")
    for kind in ("parquet", "json"):
        write_report(report, str(tmp_path / kind), kind)
        back = read_report(spark, str(tmp_path / kind), kind)
        assert reports.report_to_dict(reports.validate_report(back, "LinearRegression")) == reports.report_to_dict(report)
    assert '"MaxError":0.5' in reports.to_json(report).first()["report"]
    assert reports.to_wide(report, "LinearRegression").first()["MaxError"] == 0.5
    with pytest.raises(InvalidReportError):
        reports.validate_report(report.where("metric <> 'MaxError'"), "LinearRegression")


def test_adhoc_metrics(spark):
    from gaugeline.errors import FacetError, InvalidMetricError

    df = from_columns(spark, t=LABELS, p=GUESSES)
    for m, v in CLASSES.items():
        assert api.adhoc_classification_metric(df, m, "t", "p", label=1) == pytest.approx(v, abs=1e-6)
    probs = from_columns(spark, t=[float(x) for x in LABELS], p=PROBS)
    for m, v in (CLASSES | {"LogLoss": 0.714502180}).items():
        assert api.adhoc_classification_metric(probs, m, "t", "p", threshold=0.5) == pytest.approx(v, abs=1e-6)
    words = from_columns(spark, t=["a", "b", "c"], p=["a", "c", "c"])
    assert api.adhoc_classification_metric(words, "Accuracy", "t", "p") == pytest.approx(2 / 3)
    reg = from_columns(spark, t=T, p=P)
    assert api.adhoc_regression_metric(reg, "RSquared", "t", "p") == pytest.approx(0.743516001)
    with pytest.raises(FacetError):
        api.adhoc_regression_metric(from_columns(spark, t=[-1.0, 2.0], p=[1.0, 2.0]), "MeanSquaredLogError", "t", "p")
    with pytest.raises(EmptyDatasetError):
        api.adhoc_regression_metric(reg.limit(0), "MaxError", "t", "p")
    for f, args in ((api.adhoc_regression_metric, ("x", "t", "p")), (api.adhoc_classification_metric, ("x", "t", "p"))):
        with pytest.raises(InvalidMetricError):
            f(reg, *args)
