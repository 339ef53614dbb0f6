"""Registered queries of the eager entry points, of report and column conversions, and of bins beyond the literal edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS
from gaugeline.functions.segments import LabeledSegment, Payload, ThresholdSegment
from gaugeline.operators import analysis, api, reports
from gaugeline.operators.drift import CategoricalBaseline, ContinuousBaseline, bin_column, bin_edges
from gaugeline.plans import catalogue as K
from gaugeline.plans import oracle as O
from gaugeline.plans.catalogue import query, rounded, table, values
from gaugeline.sources import tables
from gaugeline.streaming import monitors
from gaugeline.streaming.shared import shared_folder

_NEW, _OLD = K._SHIP_NEW, K._SHIP_OLD


def _listed(spark, report: dict, family: str):
    return values(reports.report_from_dict(spark, report, family))


def _short(report: dict) -> dict:
    """Rounded as the SQL sides are, so that thresholds see the same values."""
    return {m: round(v, 6) for m, v in report.items()}


def _drifts(spark, found: dict):
    """What a report dictionary lists as failed."""
    rows = [(r["metric"], float(r["drift"])) for r in found.get("failed_report", [])]
    return rounded(spark.createDataFrame(rows, "metric string, drift double"), "drift")


# ---- eager entry points ----------------------------------------------------------------------------------------


@query("eager_data_bias_explicit", K._data_bias(K._LINE))
def eager_data_bias_explicit(spark, sf_dir):
    """Criteria as payloads, which check that a value's type is its column's."""
    lines = table(spark, sf_dir, "lineitem")
    got = api.data_bias_perform_analysis_explicit_segmentation(lines, "l_returnflag", "l_quantity", Payload("l_returnflag", K.RETURNED), Payload("l_quantity", K.MANY))
    return _listed(spark, got, DATA_BIAS)


# line numbers are few and taken as labels, prices are many and compared
@query("eager_data_bias_implied", K._data_bias("SELECT l_linenumber = 3 AS f, l_extendedprice >= 40000 AS g FROM lineitem"))
def eager_data_bias_implied(spark, sf_dir):
    """A label given as 3.7 is cut to the integer column's 3."""
    return _listed(spark, api.data_bias_perform_analysis(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice", 3.7, 40000), DATA_BIAS)


@query("eager_model_bias_explicit", K._model_bias(K._CELLS))
def eager_model_bias_explicit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _listed(spark, api.model_bias_perform_analysis_explicit_segmentation(lines, "l_returnflag", "l_extendedprice", "l_quantity", K.RETURNED, K.COSTLY, K.MANY), MODEL_BIAS)


@query("eager_linear_of_integers", f"WITH k AS {O.regression_cte('SELECT CAST(l_linenumber AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) AS p FROM lineitem')} {O.long(O.LINEAR, 'k')}")
def eager_linear_of_integers(spark, sf_dir):
    """Whole numbers are taken as doubles."""
    got = api.linear_regression_analysis(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity")
    return _listed(spark, got["performance_data"], got["model_type"])


def _both_ways(family: str, sides: tuple[str, str]) -> str:
    """Each side as the latest report against the other, so that what falls one way rises the other."""
    return " UNION ALL ".join(f"SELECT '{way}' AS way, * FROM ({O.check(family, *pair, 0.001)}) c" for way, pair in (("later", sides), ("earlier", sides[::-1])))


_LINEAR_PAIR = tuple(K._linear_sql(f" WHERE {w}") for w in (_NEW, _OLD))
_BIAS_PAIR = tuple(f"SELECT * FROM ({K._data_bias(f'{K._LINE} WHERE {w}')}) z" for w in (_NEW, _OLD))


def _told(later, earlier):
    return later.select(F.lit("later").alias("way"), "*").unionByName(earlier.select(F.lit("earlier").alias("way"), "*"))


@query("eager_runtime_check", _both_ways(analysis.LINEAR, _LINEAR_PAIR))
def eager_runtime_check(spark, sf_dir):
    rows = K._linear_rows(spark, sf_dir)
    new, old = (api.linear_regression_analysis(K._when(rows, w), "t", "p") for w in (_NEW, _OLD))
    new, old = (x | {"performance_data": _short(x["performance_data"])} for x in (new, old))
    return _told(*(_drifts(spark, api.runtime_check_full(spark, *pair, 0.001)) for pair in ((new, old), (old, new))))


@query("eager_bias_comparison", _both_ways(DATA_BIAS, _BIAS_PAIR))
def eager_bias_comparison(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    new, old = (_short(api.data_bias_perform_analysis_explicit_segmentation(K._when(lines, w), "l_returnflag", "l_quantity", K.RETURNED, K.MANY)) for w in (_NEW, _OLD))
    return _told(*(_drifts(spark, api.data_bias_runtime_comparison(spark, *pair, 0.001)) for pair in ((old, new), (new, old))))


# ---- reports as JSON and as stored tables ----------------------------------------------------------------------


@query("report_as_json", f"WITH k AS {O.facet_cte(K._BY_STATUS, 'l_linestatus')} {O.long(O.DATA_BIAS, 'k', 'l_linestatus')}")
def report_as_json(spark, sf_dir):
    """Reports by group as JSON files, read back into rows."""
    report = analysis.data_bias_report(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", K.RETURNED, K.MANY, by=["l_linestatus"])
    folder = shared_folder(spark, "reports")
    tables.write_report(reports.to_json(report, ["l_linestatus"]), folder, "json", "overwrite")
    stored = tables.read_table(spark, folder, "json", "l_linestatus string, report string")
    return values(stored.select("l_linestatus", F.explode(F.from_json("report", "map<string,double>")).alias("metric", "value")))


@query("stored_report_check", _both_ways(DATA_BIAS, _BIAS_PAIR))
def stored_report_check(spark, sf_dir):
    """Reports that were written, and checked when read, against each other."""
    lines, stored = table(spark, sf_dir, "lineitem"), []
    for w in (_NEW, _OLD):
        folder = shared_folder(spark, "reports")
        tables.write_report(values(analysis.data_bias_report(K._when(lines, w), "l_returnflag", "l_quantity", K.RETURNED, K.MANY)), folder)
        stored.append(reports.validate_report(tables.read_report(spark, folder), DATA_BIAS))
    return _told(*(rounded(reports.runtime_check(*pair, DATA_BIAS, 0.001), "drift") for pair in (stored, stored[::-1])))


# ---- columns of other types ------------------------------------------------------------------------------------

_EV_PAIR = tuple(f"SELECT value AS v FROM events WHERE {w}" for w in (K._EV_OLD, K._EV_NEW))


@query("drift_of_numbers_as_text", K._divergence(O.continuous(*_EV_PAIR, "Sturges"), O.INTERIOR))
def drift_of_numbers_as_text(spark, sf_dir):
    """Numbers that come as text, read as doubles."""
    events = tables.drift_values(table(spark, sf_dir, "events").select("ts", F.col("value").cast("string").alias("value")), "value")
    return values(ContinuousBaseline.fit(K._when(events, K._EV_OLD), "value", "Sturges").score(K._when(events, K._EV_NEW), "value"))


@query("drift_of_labels_as_numbers", K._divergence(O.categorical(*(f"SELECT CAST(l_linenumber AS VARCHAR) AS l FROM lineitem WHERE {w}" for w in (_OLD, _NEW))), O.HALF))
def drift_of_labels_as_numbers(spark, sf_dir):
    lines = tables.drift_labels(table(spark, sf_dir, "lineitem").select("l_shipdate", "l_linenumber"), "l_linenumber")
    return values(CategoricalBaseline.fit(K._when(lines, _OLD), "l_linenumber").score(K._when(lines, _NEW), "l_linenumber"))


# ---- a new baseline for a monitor ------------------------------------------------------------------------------


@query("monitor_new_baseline_drift", K._divergence(O.continuous(*_EV_PAIR, "Sturges"), O.INTERIOR))
def monitor_new_baseline_drift(spark, sf_dir):
    """What was counted against the first baseline is gone after the second one is set."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    monitor = monitors.StreamingContinuousDataDriftFlush(events, "value", "Sturges", flush_rate=10**9)
    monitor.update_stream_batch(events, 0)
    monitor.reset_baseline(K._when(events, K._EV_OLD))
    monitor.update_stream_batch(K._when(events, K._EV_NEW), 1)
    names = list(O.divergence("bins", O.INTERIOR))
    return values(spark.createDataFrame(list(zip(names, monitor.compute_drift_multiple_criteria(names), strict=True)), "metric string, value double"))


@query("monitor_new_criteria", K._data_bias("SELECT l_returnflag = 'A' AS f, l_quantity >= 10 AS g FROM lineitem WHERE " + _NEW))
def monitor_new_criteria(spark, sf_dir):
    """Other criteria flush the runtime, which then counts by them."""
    lines = table(spark, sf_dir, "lineitem")
    monitor = monitors.DataBiasStreaming(lines, "l_returnflag", "l_quantity", K.RETURNED, K.MANY)
    monitor.push_batch(lines)
    monitor.reset_baseline_and_segmentation_criteria(K._when(lines, _OLD), LabeledSegment("A"), ThresholdSegment(10.0, "GreaterThanEqualTo"))
    monitor.push_batch(K._when(lines, _NEW))
    return _listed(spark, monitor.performance_snapshot(), DATA_BIAS)


# ---- bins beyond the literal edges -----------------------------------------------------------------------------

_BINS = 6002


@query(
    "drift_bins_by_arithmetic",
    f"""WITH RECURSIVE s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
  e AS (SELECT 1 AS i, lo AS edge, (hi - lo) / {_BINS - 2} AS step FROM s UNION ALL SELECT i + 1, edge + step, step FROM e WHERE i < {_BINS - 2}),
  t AS (SELECT max(edge) AS last FROM e)
SELECT CAST(CASE WHEN l_extendedprice > t.last THEN {_BINS - 1} ELSE e.i END AS INTEGER) AS bin, count(*) AS c
FROM lineitem ASOF JOIN e ON l_extendedprice >= e.edge, t GROUP BY 1""",
)
def drift_bins_by_arithmetic(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    s = lines.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).first()
    return lines.groupBy(bin_column(F.col("l_extendedprice"), bin_edges(s["lo"], s["hi"], _BINS), _BINS).alias("bin")).agg(F.count("*").alias("c"))
