"""Reports as rows (metric, value), and the comparison of a latest report with a baseline.

A report may carry group columns ``by``; comparisons then pair rows of the same group. Reports are small (one row for
a metric and group), and Spark sizes them itself when it plans the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.errors import InvalidReportError
from gaugeline.functions.ieee import div, gt, ge
from gaugeline.functions.metrics import DATA_BIAS, FAMILIES, MODEL_BIAS, ModelType, metric_names

#: Default drift threshold, and the least denominator of a relative snapshot.
THRESHOLD, STABILITY_EPS = 0.10, 1e-12

BINARY, LOGISTIC, LINEAR = (m.value for m in (ModelType.BinaryClassification, ModelType.LogisticRegression, ModelType.LinearRegression))


def to_long(wide: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, value) from cell columns and finished metric columns."""
    ready = wide.select(*by, *[c.cast("double").alias(m) for m, c in metrics.items()])
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return ready.select(*by, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))


def to_wide(report: DataFrame, family: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group with a column for each metric of the family; absent metrics are null."""
    return report.groupBy(*by).pivot("metric", list(metric_names(family))).agg(F.first("value"))


def report_from_dict(spark: SparkSession, values: Mapping[str, float], family: str, complete: bool = True) -> DataFrame:
    """A report table from metric -> value; unknown names raise, and missing ones if ``complete``."""
    names = FAMILIES[family]
    if bad := [m for m in values if m not in names]:
        raise InvalidReportError(f"not {family} metrics: {', '.join(map(str, bad))}")
    if complete and (missing := [m for m in names if m not in values]):
        raise InvalidReportError(f"missing {family} metrics: {', '.join(missing)}")
    return spark.createDataFrame([(str(m), float(v)) for m, v in values.items()], "metric string, value double")


def report_to_dict(report: DataFrame) -> dict[str, float]:
    """metric -> value of an ungrouped report."""
    return {r["metric"]: r["value"] for r in report.select("metric", "value").collect()}


def validate_report(report: DataFrame, family: str) -> DataFrame:
    """The report, after a check that it holds the family's metrics and no others."""
    have = {r["metric"] for r in report.select("metric").distinct().collect()}
    want = set(FAMILIES[family])
    if have != want:
        raise InvalidReportError(f"{family} report: missing {sorted(want - have)}, unknown {sorted(have - want)}")
    return report


def to_json(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One JSON object for each group: column ``report``."""
    return report.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("report"))


def _paired(latest: DataFrame, baseline: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    keys = [*by, "metric"]
    x = latest.where(F.col("metric").isin(list(metrics))).select(*keys, F.col("value").alias("x"))
    return x.join(baseline.select(*keys, F.col("value").alias("b")), keys)


def _is(*names: str) -> Column:
    return F.col("metric").isin(list(names))


def _check(family: str, t: float) -> tuple[Column, Column]:
    """(fails, drift) of a metric's latest value x against its baseline b."""
    x, b = F.col("x"), F.col("b")
    risen, swollen = gt(x, b * (1 + t)), gt(F.abs(x), F.abs(b) * (1 + t))
    distance, stretch = F.abs(x - b), F.abs(F.abs(x) - F.abs(b))
    if family == DATA_BIAS:
        signed = _is("ClassImbalance", "DifferenceInProportionOfLabels")
        return F.when(signed, swollen).otherwise(risen), F.when(_is("ClassImbalance"), stretch).when(signed, distance).otherwise(x - b)
    if family == MODEL_BIAS:
        ratio = _is("DisparateImpact", "GeneralizedEntropy")
        return F.when(ratio, risen).otherwise(swollen), F.when(ratio, distance).otherwise(stretch)
    if family == BINARY:
        return gt(b, x * (1 + t)), b - x
    good = _is("RSquared") if family == LINEAR else ~_is("LogLoss")
    return F.when(good, gt(b * (1 - t), x)).otherwise(risen), F.when(good, b - x).otherwise(x - b)


def runtime_check(latest: DataFrame, baseline: DataFrame, family: str, threshold: float = THRESHOLD, metrics: Iterable[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, drift) of the metrics that fail against the baseline. A NaN never fails."""
    fails, drift = _check(family, threshold)
    return _paired(latest, baseline, metric_names(family, metrics), by).where(fails).select(*by, "metric", drift.alias("drift"))


def drift_snapshot(latest: DataFrame, baseline: DataFrame, family: str, metrics: Iterable[str] | None = None, by: Sequence[str] = (), eps: float = STABILITY_EPS) -> DataFrame:
    """(by..., metric, value): each metric's drift as monitors see it.

    Bias families give the relative distance (data bias with a denominator of ``eps`` at least, model bias without),
    classification families the signed loss ``baseline - latest`` (log loss too), linear regression the distance.
    """
    x, b = F.col("x"), F.col("b")
    if family == DATA_BIAS:
        value = F.abs(x - b) / F.greatest(F.abs(b), F.lit(eps))
    elif family == MODEL_BIAS:
        value = div(F.abs(x - b), F.abs(b))
    elif family == LINEAR:
        value = F.abs(b - x)
    else:
        value = b - x
    return _paired(latest, baseline, metric_names(family, metrics), by).select(*by, "metric", value.alias("value"))


def snapshot_failures(snapshot: DataFrame, threshold: float = THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, drift) of the snapshot's metrics at or above the threshold; NaN never fails."""
    return snapshot.where(ge(F.col("value"), F.lit(threshold))).select(*by, "metric", F.col("value").alias("drift"))


def fold_report(failures: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """(by..., passed, failed_report): passed where nothing failed, else the failures in order of their names.

    ``groups`` lists all groups, so that those without a failure pass; without group columns there is one row.
    """
    listed = F.array_sort(F.collect_list(F.struct("metric", "drift")))
    folded = failures.groupBy(*by).agg(listed.alias("failed_report"))
    if by and groups is not None:
        folded = groups.select(*by).distinct().join(folded, list(by), "left")
    size = F.coalesce(F.size("failed_report"), F.lit(0))
    return folded.select(*by, (size <= 0).alias("passed"), F.when(size > 0, F.col("failed_report")).alias("failed_report"))


def drift_report_dict(failures: DataFrame) -> dict:
    """{"passed": True}, or passed False with failed_report: a list of metric and drift."""
    rows = [{"metric": r["metric"], "drift": r["drift"]} for r in failures.orderBy("metric").collect()]
    return {"passed": False, "failed_report": rows} if rows else {"passed": True}
