import math

import pytest
from pyspark.sql import functions as F

from gaugeline.errors import EmptyDatasetError, FacetError, InvalidMetricError, InvalidReportError, PayloadTypeError, SegmentError
from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS
from gaugeline.functions.segments import ColumnSegment, LabeledSegment, Payload, ThresholdSegment, segment
from gaugeline.operators import analysis, api, reports
from gaugeline.sources.tables import from_columns

FEATURE = [1, 0, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 1]
TRUTH = [0, 1, 1, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 1]


@pytest.fixture(scope="module")
def f1(spark):
    return from_columns(spark, feature=FEATURE, gt=TRUTH)


def model_rows(spark, pred, gt):
    return from_columns(spark, feature=[1, 1, 1, 1, 0, 0, 0, 0], pred=pred, gt=gt)


@pytest.fixture(scope="module")
def symmetric(spark):
    return model_rows(spark, [1, 1, 0, 0, 1, 1, 0, 0], [1, 0, 1, 0, 1, 0, 1, 0])


@pytest.fixture(scope="module")
def asymmetric(spark):
    return model_rows(spark, [1, 1, 1, 0, 0, 1, 0, 0], [1, 1, 0, 1, 1, 0, 1, 0])


def test_data_bias_values(f1):
    got = api.data_bias_perform_analysis(f1, "feature", "gt", 1, 1)
    want = {"ClassImbalance": 0, "DifferenceInProportionOfLabels": 0.5, "KlDivergence": 0.582685303, "JsDivergence": 0.132505451, "LpNorm": 0.707106781, "TotalVariationDistance": 0.5, "KolmogorovSmirnov": 0.5}
    assert got == pytest.approx(want, abs=1e-8)


def test_data_bias_text_and_thresholds(spark):
    words = from_columns(spark, feature=["male", "female", "male", "male", "female", "male"], gt=["yes", "no", "yes", "no", "yes", "no"])
    assert api.data_bias_perform_analysis(words, "feature", "gt", "male", "yes")["DifferenceInProportionOfLabels"] == pytest.approx(0)
    numbers = from_columns(spark, feature=[0.3, 0.7, 0.2, 0.8, 0.6, 0.4], gt=[0.6, 0.3, 0.7, 0.4, 0.8, 0.2])
    half = ThresholdSegment(0.5, "GreaterThanEqualTo")
    got = api.data_bias_perform_analysis_explicit_segmentation(numbers, "feature", "gt", half, half)
    assert got["DifferenceInProportionOfLabels"] == pytest.approx(-1 / 3)


def test_degenerate_facets_raise(spark):
    one_sided = from_columns(spark, feature=[1, 1, 1], gt=[1, 0, 1])
    with pytest.raises(FacetError):
        api.data_bias_perform_analysis(one_sided, "feature", "gt", 1, 1)
    with pytest.raises(EmptyDatasetError):
        api.data_bias_perform_analysis(one_sided.limit(0), "feature", "gt", 1, 1)
    # the lazy form gives NaN instead
    lazy = reports.report_to_dict(analysis.data_bias_report(one_sided, "feature", "gt", LabeledSegment(1), LabeledSegment(1)))
    assert lazy["ClassImbalance"] == 1 and math.isnan(lazy["LpNorm"])


def test_nulls_are_left_out(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (None, 1), (1, None), (1, 0), (0, 0)], "feature int, gt int")
    assert api.data_bias_perform_analysis(rows, "feature", "gt", 1, 1)["ClassImbalance"] == 0


SUITE = {
    "DifferenceInPositivePredictedLabels": (0, 0.5), "DisparateImpact": (1, 3), "AccuracyDifference": (0, 0.25), "RecallDifference": (0, 2 / 3), "DifferenceInConditionalAcceptance": (0, 0.5),
    "DifferenceInAcceptanceRate": (0, 2 / 3), "SpecialityDifference": (0, -0.5), "DifferenceInConditionalRejection": (0, -1 / 3), "DifferenceInRejectionRate": (0, 1 / 3),
    "TreatmentEquity": (0, 1), "ConditionalDemographicDesparityPredictedLabels": (0, 0), "GeneralizedEntropy": (3.52, 6),
}


def test_model_bias_suite(symmetric, asymmetric):
    for k, df in enumerate((symmetric, asymmetric)):
        got = api.model_bias_perform_analysis(df, "feature", "gt", "pred", 1, 1, 1)
        assert got == pytest.approx({m: v[k] for m, v in SUITE.items()}, abs=1e-9)


def test_model_bias_adhoc(symmetric, asymmetric):
    one = LabeledSegment(1)
    for df, entropy, parity in ((symmetric, 14.08, 0), (asymmetric, 24, 0.5)):
        got = reports.report_to_dict(analysis.model_bias_report(df, "feature", "gt", "pred", one, one, one, adhoc=True))
        assert got["GeneralizedEntropy"] == pytest.approx(entropy)
        assert got["ConditionalDemographicDesparityPredictedLabels"] == pytest.approx(parity)
    assert api.adhoc_metric(asymmetric, "SpecialityDifference", "feature", "gt", one, one, "pred", one) == pytest.approx(0.5)
    assert api.adhoc_metric(asymmetric, "ClassImbalance", "feature", "gt", one, one) == 0
    with pytest.raises(InvalidMetricError):
        api.adhoc_metric(asymmetric, "Nothing", "feature", "gt", one, one)


def test_model_bias_from_counts(spark):
    cells = spark.createDataFrame([(4, 5, 6, 4, 5, 3, 4, 6)], "a_tp long, a_fp long, a_tn long, a_fn long, d_tp long, d_fp long, d_tn long, d_fn long")
    got = reports.report_to_dict(analysis.finish(cells, MODEL_BIAS))
    assert got["AccuracyDifference"] == pytest.approx(10 / 19 - 9 / 18)
    assert got["RecallDifference"] == pytest.approx(4 / 8 - 5 / 11)
    assert got["DifferenceInAcceptanceRate"] == pytest.approx(4 / 9 - 5 / 8)
    assert got["SpecialityDifference"] == pytest.approx(6 / 11 - 4 / 7)


def test_segments():
    assert segment(1, "Label") == LabeledSegment(1)
    assert segment(0.5, "Threshold", "LessThan").value == 0.5
    for bad in (("x", "Label", "LessThan"), ("x", "Threshold", None), ("x", "Other", None), ("x", "Threshold", "Near")):
        with pytest.raises(SegmentError):
            segment(*bad)


def test_nan_fails_every_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    for kind, want in (("GreaterThan", [2.0]), ("GreaterThanEqualTo", [1.0, 2.0]), ("LessThan", []), ("LessThanEqualTo", [1.0])):
        got = [r.v for r in df.where(Payload("v", ThresholdSegment(1.0, kind)).resolve(df)).orderBy("v").collect()]
        assert got == want, kind


def test_payload_types(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "i int, s string, d double")
    for column, value in (("i", "a"), ("s", 1), ("d", 1)):
        with pytest.raises(PayloadTypeError):
            Payload(column, LabeledSegment(value)).resolve(df)
    assert df.where(ColumnSegment(F.col("i") + 0 == 1).column(F.col("s"))).count() == 1


def test_dates_segment(spark):
    df = spark.sql("SELECT cast('2024-01-0' || k AS date) AS d FROM range(1, 6) t(k)")
    import datetime

    assert df.where(Payload("d", ThresholdSegment(datetime.date(2024, 1, 3), "GreaterThan")).resolve(df)).count() == 2


def test_heuristic(spark):
    many = from_columns(spark, v=[float(i) for i in range(100)], k=[i % 3 for i in range(100)], b=[i % 2 == 0 for i in range(100)])
    from gaugeline.functions.segments import heuristic_segment as h

    assert many.where(h(many, "v", 90.0)).count() == 10
    assert many.where(h(many, "k", 2)).count() == 33
    assert many.where(h(many, "k", 2.9)).count() == 33
    assert many.where(h(many, "b", 1)).count() == 50
    assert many.where(h(many, "b", 7)).count() == 50
    with pytest.raises(TypeError):
        h(many, "v", "x")


def test_runtime_check(spark, f1):
    base = dict.fromkeys((m for m in reports.FAMILIES[DATA_BIAS]), 0.2)
    assert api.data_bias_runtime_comparison(spark, base, base) == {"passed": True}
    late = base | {"KlDivergence": 0.5, "LpNorm": 0.21}
    got = api.data_bias_runtime_comparison(spark, base, late)
    assert not got["passed"] and [r["metric"] for r in got["failed_report"]] == ["KlDivergence"]
    assert got["failed_report"][0]["drift"] == pytest.approx(0.3)
    assert api.data_bias_partial_runtime_comparison(spark, base, late, ["LpNorm"])["passed"]
    with pytest.raises(InvalidReportError):
        api.data_bias_runtime_comparison(spark, {"LpNorm": 1.0}, base)
    with pytest.raises(InvalidMetricError):
        api.data_bias_partial_runtime_comparison(spark, base, late, ["Accuracy"])


def test_negative_values_compare_by_size(spark):
    base = dict.fromkeys(reports.FAMILIES[MODEL_BIAS], 0.2)
    late = base | {"RecallDifference": -0.5, "DisparateImpact": 0.1}
    got = api.model_bias_runtime_comparison(spark, base, late)
    assert [(r["metric"], round(r["drift"], 6)) for r in got["failed_report"]] == [("RecallDifference", 0.3)]
    assert api.model_bias_partial_runtime_comparison(spark, base, late, ["DisparateImpact"])["passed"]


def test_nan_never_fails(spark):
    nan = float("nan")
    base = dict.fromkeys(reports.FAMILIES[DATA_BIAS], 0.2)
    for a, b in ((base | {"LpNorm": nan}, base), (base, base | {"LpNorm": nan})):
        assert api.data_bias_runtime_comparison(spark, a, b)["passed"]


def test_grouped_equals_single(spark, f1):
    rows = f1.withColumn("g", F.lit("a")).unionByName(f1.withColumn("g", F.lit("b")))
    one = LabeledSegment(1)
    grouped = analysis.data_bias_report(rows, "feature", "gt", one, one, by=["g"])
    single = reports.report_to_dict(analysis.data_bias_report(f1, "feature", "gt", one, one))
    for g in "ab":
        assert reports.report_to_dict(grouped.where(F.col("g") == g)) == single
    base = grouped.withColumn("value", F.when((F.col("g") == "b"), F.col("value") / 2).otherwise(F.col("value")))
    failed = reports.runtime_check(grouped, base, DATA_BIAS, by=["g"])
    folded = {r["g"]: r["passed"] for r in reports.fold_report(failed, ["g"], grouped).collect()}
    assert folded == {"a": True, "b": False}


def test_plan_has_one_exchange_and_a_pruned_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    report = analysis.data_bias_report(df, "l_returnflag", "l_quantity", LabeledSegment("R"), ThresholdSegment(25.0, "GreaterThanEqualTo"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "l_extendedprice" not in plan and "Python" not in plan


def test_share_of_distinct_values_is_a_parameter(spark):
    rows = from_columns(spark, f=[1, 1, 2, 3, 4, 4, 4, 4], g=[1, 0, 1, 0, 1, 0, 1, 0])
    # as a threshold 2 and above are the facet, as a label only 2 itself
    assert api.data_bias_perform_analysis(rows, "f", "g", 2, 1)["ClassImbalance"] == pytest.approx(abs(6 - 2) / 8)
    assert api.data_bias_perform_analysis(rows, "f", "g", 2, 1, share=0.5)["ClassImbalance"] == pytest.approx(abs(1 - 7) / 8)
