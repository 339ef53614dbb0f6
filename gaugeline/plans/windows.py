"""Registered queries of sliding windows by panes, distributed numbering, and dictionaries that stay tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.segments import LabeledSegment, ThresholdSegment
from gaugeline.operators import analysis
from gaugeline.operators.numbering import number_rows
from gaugeline.plans import catalogue as K
from gaugeline.plans import oracle as O
from gaugeline.plans.catalogue import query, rounded, table, values
from gaugeline.streaming import live, panes
from gaugeline.streaming.dictionary import DictionaryMonitor
from gaugeline.streaming.shared import replay, shared_folder

# ---- sliding windows by panes ----------------------------------------------------------------------------------


def _windows(source: str, ts: str, hours: int, slide: int) -> str:
    """Starts of all windows that could hold a row of the table."""
    at = lambda f: f"CAST(floor(epoch({f}({ts})) / {3600 * slide}) AS BIGINT)"
    return f"w AS MATERIALIZED (SELECT TIMESTAMP '1970-01-01' + to_hours(i * {slide}) AS started FROM (SELECT unnest(range({at('min')} - {-(-hours // slide)}, {at('max')} + 1)) AS i FROM {source}))"


def _in_window(ts: str, hours: int) -> str:
    return f"{ts} >= w.started AND {ts} < w.started + INTERVAL {hours} HOUR"


_COUNTED = "SELECT w.started, event_type, count(*) AS n, max(value) AS max_value, min(value) AS min_value, round(sum(value), 6) + 0.0 AS total FROM events JOIN w ON {} GROUP BY ALL"


def _value_cells(df, by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.sum("value").alias("total"))


def _started(df, *columns):
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("started"), *columns)


for _name, _hours, _slide in (("month_by_day", 720, 24), ("uneven", 60, 24), ("overlap_by_hours", 30, 7), ("tumbling", 12, 12)):

    @query(f"sliding_cells_{_name}", f"WITH {_windows('events', 'ts', _hours, _slide)} {_COUNTED.format(_in_window('ts', _hours))}")
    def sliding_cells(spark, sf_dir, hours=_hours, slide=_slide):
        out = panes.sliding_cells(table(spark, sf_dir, "events"), "ts", f"{hours} hours", f"{slide} hours", _value_cells, ["event_type"])
        return rounded(_started(out, "event_type", "n", "max_value", "min_value", "total"), "total")


_WEEK = f"SELECT w.started, event_type = 'click' AS f, value >= 50 AS g FROM events JOIN w ON {_in_window('ts', 168)}"


@query("sliding_data_bias", f"WITH {_windows('events', 'ts', 168, 24)}, k AS {O.facet_cte(_WEEK, 'started')} {O.long(O.DATA_BIAS, 'k', 'started')}")
def sliding_data_bias(spark, sf_dir):
    out = panes.sliding_data_bias(table(spark, sf_dir, "events"), "ts", "7 days", "1 day", "event_type", "value", LabeledSegment("click"), ThresholdSegment(50.0, "GreaterThanEqualTo"))
    return values(_started(out, "metric", "value"))


# roots, since means of few decimals often end in a five at the digit that is rounded
_MONTH = f"SELECT w.started, CAST(l_quantity AS DOUBLE) AS t, l_quantity * sqrt(1 - l_discount) + 10 * l_tax AS p FROM lineitem JOIN w ON {_in_window('l_shipdate', 720)}"


# short windows at the ends may hold one truth only, for which the suite has a rule of its own
_SUITE = O.LINEAR | {"RSquared": f"CASE WHEN st2 - st * st / n <> 0 THEN {O.LINEAR['RSquared']} WHEN e2 = 0 THEN 1 ELSE 0 END"}


@query("sliding_linear", f"WITH {_windows('lineitem', 'l_shipdate', 720, 24)}, k AS {O.regression_cte(_MONTH, 'started')} {O.long(_SUITE, 'k', 'started')}")
def sliding_linear(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", q.alias("t"), (q * F.sqrt(1 - F.col("l_discount")) + 10 * F.col("l_tax")).alias("p"))
    out = panes.sliding_linear(rows, "l_shipdate", "30 days", "1 day", "t", "p")
    return values(_started(out, "metric", "value"))


_LAST = "(SELECT max(ts) - INTERVAL 1 HOUR AS at FROM events)"


@query(
    "sliding_cells_stream",
    f"""WITH {_windows('events', 'ts', 60, 24)}, closed AS (SELECT e.* FROM events e, {_LAST} m WHERE time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 12 HOUR <= m.at)
{_COUNTED.replace("FROM events", "FROM closed").format(_in_window("ts", 60))}""",
)
def sliding_cells_stream(spark, sf_dir):
    """The panes that a stream has appended by its end, put together into windows as a table."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    closed = replay(panes.pane_cells(stream, "ts", "60 hours", "24 hours", _value_cells, ["event_type"], "1 hour"), "panes")
    out = panes.window_cells(closed, "60 hours", "24 hours", ["event_type"])
    return rounded(_started(out, "event_type", "n", "max_value", "min_value", "total"), "total")


# ---- numbering -------------------------------------------------------------------------------------------------


@query("number_rows_by_group", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts), event_id) - 1 AS number FROM events")
def number_rows_by_group(spark, sf_dir):
    """Days as times: all rows of a day are ties but for their id."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    return number_rows(events, ["day", "event_id"], ["event_type"], unique=True).select("event_type", "event_id", "number")


@query("number_rows_with_copies", "SELECT l_returnflag, l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_linenumber) - 1 AS number FROM lineitem")
def number_rows_with_copies(spark, sf_dir):
    """Rows that are equal in all columns have numbers of their own."""
    return number_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_linenumber"), ["l_quantity", "l_linenumber"], ["l_returnflag"])


@query(
    "flush_windows_by_group",
    f"""WITH r AS (SELECT user_id % 3 AS g, value, ts, event_id, (row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1) // {K._RATE} AS flush_window FROM events)
SELECT g, flush_window, count(*) AS n, min(ts) AS started, max(value) AS top FROM r GROUP BY ALL""",
)
def flush_windows_by_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("g"), "ts", "event_id", "value")
    windows = live.flush_windows(events, ["ts", "event_id"], K._RATE, ["g"], unique=True)
    return windows.groupBy("g", "flush_window").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("value").alias("top"))


# ---- dictionaries ----------------------------------------------------------------------------------------------

_OLD, _NEW = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'"
_PART = "SELECT CAST(l_partkey AS VARCHAR) AS l FROM lineitem WHERE "
# parts below a tenth of the largest key are missing from the dictionary
_KNOWN = " AND l_partkey > (SELECT max(l_partkey) // 10 FROM lineitem)"


def _dictionary(spark, sf_dir) -> DictionaryMonitor:
    """Three batches, one of them twice, a merge between, and an earlier baseline that was replaced."""
    lines = table(spark, sf_dir, "lineitem")
    least = lines.agg(F.floor(F.max("l_partkey") / 10).alias("least"))
    monitor = DictionaryMonitor(spark, shared_folder(spark, "dictionary"), "l_partkey", compact_every=2)
    monitor.reset_baseline(lines, 1)
    monitor.push_batch(lines, 0)
    monitor.reset_baseline(K._when(lines, _OLD).join(F.broadcast(least), F.col("l_partkey") > F.col("least")), 2)
    for k in range(3):
        for _ in range(2 if k else 1):
            monitor.push_batch(K._when(lines, _NEW).where(F.col("l_linenumber") % 3 == k), 1 + k)
    return monitor


@query("dictionary_drift", K._divergence(O.categorical(f"{_PART}{_OLD}{_KNOWN}", _PART + _NEW), O.HALF))
def dictionary_drift(spark, sf_dir):
    return values(_dictionary(spark, sf_dir).drift())


@query(
    "dictionary_snapshot",
    f"""WITH b AS (SELECT l, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM ({_PART}{_OLD}{_KNOWN}) GROUP BY l),
  r AS (SELECT b.l, count(*) AS n FROM ({_PART}{_NEW}) x LEFT JOIN b USING (l) GROUP BY b.l)
SELECT coalesce(b.l, r.l) AS label, round(coalesce(p, 0), 6) + 0.0 AS p, coalesce(n, 0) AS n FROM b FULL JOIN r ON b.l IS NOT DISTINCT FROM r.l""",
)
def dictionary_snapshot(spark, sf_dir):
    return rounded(_dictionary(spark, sf_dir).snapshot(), "p")
