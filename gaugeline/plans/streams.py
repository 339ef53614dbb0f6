"""Registered queries of keyed and streaming forms: delayed labels, monitors by key, flush and decay in the state store.

Streams are replayed from the given tables to their end; the SQL says what must have been appended by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS
from gaugeline.operators import analysis
from gaugeline.operators.drift import CategoricalBaseline, ContinuousBaseline
from gaugeline.plans import catalogue as K
from gaugeline.plans import oracle as O
from gaugeline.plans.catalogue import query, rounded, table, values
from gaugeline.streaming import keyed, labels
from gaugeline.streaming.celllog import CellLog, KeyedMonitor
from gaugeline.streaming.shared import replay, shared_folder

# ---- delayed labels --------------------------------------------------------------------------------------------
# Every third event is a prediction and the one after each a label, for one of thirteen neighbouring predictions: the
# numbers within a block of thirteen are reversed, so half of the labels come before their predictions, the others late.

_WITHIN, _GRACE = "40 minutes", "100 minutes"


def _predictions(events: DataFrame) -> DataFrame:
    return events.where("event_id % 3 = 0").select(F.floor(F.col("event_id") / 3).alias("n"), F.col("ts").cast("timestamp").alias("predicted_at"), "event_type", (F.col("value") >= 50).alias("guess"))


def _truths(events: DataFrame) -> DataFrame:
    m = F.floor(F.col("event_id") / 3)
    return events.where("event_id % 3 = 1").select((m - m % 13 + 12 - m % 13).alias("n"), F.col("ts").cast("timestamp").alias("labelled_at"), (F.col("value") >= 45).alias("truth"))


_CHANGES = """WITH p AS (SELECT event_id // 3 AS n, ts AS predicted_at, event_type, value >= 50 AS guess FROM events WHERE event_id % 3 = 0),
  t AS (SELECT m - m % 13 + 12 - m % 13 AS n, ts AS labelled_at, value >= 45 AS truth FROM (SELECT *, event_id // 3 AS m FROM events WHERE event_id % 3 = 1)),
  j AS (SELECT p.*, t.labelled_at, t.truth, t.labelled_at >= predicted_at AND t.labelled_at <= predicted_at + INTERVAL 40 MINUTE AS timely,
      t.labelled_at > predicted_at + INTERVAL 40 MINUTE AND t.labelled_at <= predicted_at + INTERVAL 100 MINUTE AS late FROM p LEFT JOIN t USING (n)),
  mark AS (SELECT least((SELECT max(predicted_at) FROM p), (SELECT max(labelled_at) FROM t)) - INTERVAL 1 HOUR AS at),
  c AS (
    SELECT n, event_type, guess, truth, 'labelled' AS status, 1 AS change FROM j WHERE timely
    UNION ALL SELECT n, event_type, guess, NULL, 'unlabelled', 1 FROM j, mark WHERE NOT coalesce(timely, false){open}
    UNION ALL SELECT n, event_type, guess, NULL, 'unlabelled', -1 FROM j WHERE late
    UNION ALL SELECT n, event_type, guess, truth, 'late', 1 FROM j WHERE late)
"""
_OPEN = " AND predicted_at + INTERVAL 40 MINUTE < mark.at"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; a pattern may stand for a folder or a single file, which a plain path may not."""
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")


def _changes(events: DataFrame) -> DataFrame:
    return labels.label_changes(_predictions(events), _truths(events), "n", "predicted_at", "labelled_at", _WITHIN, _GRACE, delay="1 hour")


@query("delayed_labels", _CHANGES.format(open="") + "SELECT n, truth, status, change FROM c")
def delayed_labels(spark, sf_dir):
    return _changes(table(spark, sf_dir, "events")).select("n", "truth", "status", "change")


@query("delayed_labels_stream", _CHANGES.format(open=_OPEN) + "SELECT n, truth, status, change FROM c")
def delayed_labels_stream(spark, sf_dir):
    """As appended by a stream: predictions whose time is not over at its last watermark are still open."""
    return replay(_changes(_streamed(spark, sf_dir)), "labels").select("n", "truth", "status", "change")


@query(
    "delayed_label_cells",
    _CHANGES.format(open=_OPEN)
    + """SELECT event_type, CAST(coalesce(sum(change) FILTER (WHERE truth AND guess), 0) AS BIGINT) AS tp, CAST(coalesce(sum(change) FILTER (WHERE NOT truth AND guess), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(change) FILTER (WHERE NOT truth AND NOT guess), 0) AS BIGINT) AS tn, CAST(coalesce(sum(change) FILTER (WHERE truth AND NOT guess), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(change) FILTER (WHERE status = 'unlabelled'), 0) AS BIGINT) AS unlabelled FROM c GROUP BY event_type""",
)
def delayed_label_cells(spark, sf_dir):
    """The stream's changes counted by type, batch by batch, with a batch that is run twice and a merge between."""
    names = ["tp", "fp", "tn", "fn", "unlabelled"]
    log = CellLog(spark, shared_folder(spark, "cells"), ["event_type"], names)
    changes = replay(_changes(_streamed(spark, sf_dir)), "labels")
    for k in range(3):
        part = labels.changed_cells(changes.where(F.pmod(F.xxhash64("n", "status"), F.lit(3)) == k), F.col("truth"), F.col("guess"), ["event_type"])
        log.append(part, k)
        log.append(part, k)
        if k == 1:
            log.compact()
            log.append(part, k)
    return log.read()


# ---- monitors by key -------------------------------------------------------------------------------------------

_SUPPLIER = "l_suppkey"
_ALWAYS, _TURN = "1970-01-01", "1995-06-17"


def _by_supplier(rows: str) -> str:
    return rows.replace("SELECT ", f"SELECT {_SUPPLIER}, ", 1)


def _count_facets(df, by):
    return analysis.facet_counts(df, F.col("l_returnflag") == "R", F.col("l_quantity") >= 25, by)


def _count_models(df, by):
    return analysis.model_counts(df, F.col("l_returnflag") == "R", F.col("l_extendedprice") >= 50000, F.col("l_quantity") >= 25, by)


def _count_binary(df, by):
    return analysis.confusion_counts(df, F.col("l_extendedprice") >= 50000, F.col("l_quantity") >= 25, by)


def _guess(df: DataFrame) -> DataFrame:
    """A probability that follows the quantity, for the truth that a line is costly."""
    return df.withColumn("y", (F.col("l_extendedprice") >= 50000).cast("double")).withColumn("p", F.col("l_quantity") / (F.col("l_quantity") + 25.0))


def _count_logistic(df, by):
    rows = _guess(df)
    return analysis.logistic_counts(rows, F.col("y"), F.col("p"), F.col("y") == 1.0, 0.5, by)


def _count_linear(df, by):
    q = F.col("l_quantity")
    return analysis.regression_sums(df, q, q * (1 - F.col("l_discount")) + 10 * F.col("l_tax"), by)


_GUESS = "SELECT l_suppkey, y AS t, p, y = 1 AS g, p >= 0.5 AS h FROM (SELECT l_suppkey, CASE WHEN l_extendedprice >= 50000 THEN 1.0::DOUBLE ELSE 0 END AS y, l_quantity / (l_quantity + 25.0::DOUBLE) AS p FROM lineitem)"
_KEYED = {
    "data_bias": (DATA_BIAS, _count_facets, O.facet_cte(_by_supplier(K._LINE), _SUPPLIER), O.DATA_BIAS),
    "model_bias": (MODEL_BIAS, _count_models, O.model_cte(_by_supplier(K._CELLS), _SUPPLIER), {m: x for m, x in O.MODEL_BIAS.items() if m != "TreatmentEquity"}),
    "binary": (analysis.BINARY, _count_binary, O.confusion_cte("SELECT l_suppkey, l_extendedprice >= 50000 AS g, l_quantity >= 25 AS h FROM lineitem", by=_SUPPLIER), O.CLASSIFICATION),
    "logistic": (analysis.LOGISTIC, _count_logistic, O.confusion_cte(_GUESS, O.PENALTY, _SUPPLIER), O.LOGISTIC),
    "linear": (analysis.LINEAR, _count_linear, O.regression_cte(_by_supplier(K._REG), _SUPPLIER), O.LINEAR),
}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_SUPPLIER, "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def _keyed_monitor(spark: SparkSession, name: str) -> KeyedMonitor:
    family, count, _, _ = _KEYED[name]
    return KeyedMonitor(spark, shared_folder(spark, f"keyed-{name}"), family, [_SUPPLIER], "l_shipdate", count)


for _name, (_, _, _cte, _metrics) in _KEYED.items():

    @query(f"keyed_replay_{_name}", f"WITH k AS {_cte} {O.long(_metrics, 'k', _SUPPLIER)}")
    def keyed_replay(spark, sf_dir, name=_name, metrics=tuple(_metrics)):
        """A monitor for every supplier, fed by line number; batches are run twice, and merged on the way."""
        lines, monitor = _lines(spark, sf_dir), _keyed_monitor(spark, name)
        monitor.reset_baseline(lines, _ALWAYS, 0)
        for k in range(3):
            part = lines.where(F.col("l_linenumber") % 3 == k)
            monitor.push_batch(part, k)
            if k == 1:
                monitor.push_batch(part, k)
                monitor.runtime.compact()
        return values(monitor.performance().where(F.col("metric").isin(*metrics)).select(_SUPPLIER, "metric", "value"))


def _raw(metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {_SUPPLIER}, version, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM {source}" for m, x in metrics.items())


def _versions(rows: str) -> str:
    """Data-bias metrics by supplier and version of rows that have a column version."""
    return f"(WITH k AS {O.facet_cte(rows, f'{_SUPPLIER}, version')} {_raw(O.DATA_BIAS, 'k')})"


_LINES = f"SELECT {_SUPPLIER}, {{}} AS version, l_returnflag = 'R' AS f, l_quantity >= 25 AS g FROM lineitem"
_VERSION = f"CASE WHEN l_shipdate >= TIMESTAMP '{_TURN}' THEN 1 ELSE 0 END"


@query(
    "keyed_baseline_change",
    f"""SELECT {_SUPPLIER}, version, metric, round({O.SNAPSHOTS[DATA_BIAS]}, 6) + 0.0 AS value FROM (SELECT {_SUPPLIER}, version, metric, l.value AS x, b.value AS b
  FROM {_versions(_LINES.format(_VERSION))} l JOIN {_versions(_LINES.format(0) + " WHERE l_linenumber <= 3 UNION ALL " + _LINES.format(1) + " WHERE l_linenumber >= 2")} b USING ({_SUPPLIER}, version, metric))""",
)
def keyed_baseline_change(spark, sf_dir):
    """Two baselines on a running stream: rows come by line number, that is in no order of time, and each meets the one of its time."""
    lines, monitor = _lines(spark, sf_dir), _keyed_monitor(spark, "data_bias")
    monitor.reset_baseline(lines.where("l_linenumber <= 3"), _ALWAYS, 0)
    monitor.reset_baseline(lines.where("l_linenumber >= 2"), _TURN, 1)
    for k in range(2):
        monitor.push_batch(lines.where(F.col("l_linenumber") % 2 == k), k)
    return values(monitor.drift())


@query(
    "keyed_reset",
    f"SELECT {_SUPPLIER}, CASE WHEN l_shipdate >= TIMESTAMP '{_TURN}' AND {_SUPPLIER} % 2 = 0 THEN 1 ELSE 0 END AS version, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def keyed_reset(spark, sf_dir):
    """Rows by version where every second supplier's runtime was started anew, after a restart of the monitor."""
    lines, monitor = _lines(spark, sf_dir), _keyed_monitor(spark, "data_bias")
    monitor.reset_baseline(lines, _ALWAYS, 0)
    again = KeyedMonitor(spark, monitor.baselines.folder.rsplit("/", 1)[0], DATA_BIAS, [_SUPPLIER], "l_shipdate", _count_facets)
    again.reset(lines.where(F.col(_SUPPLIER) % 2 == 0), _TURN, 1)
    again.push_batch(lines, 0)
    return again.runtime.read().select(_SUPPLIER, "version", (F.col("n_a") + F.col("n_d")).alias("n"))


# ---- flush and decay in the state store ------------------------------------------------------------------------

_RATE, _CADENCE_H = 60, 12
#: Windows of a stream of all events by user_id % 7, as far as its rows and its last watermark end them.
_WINDOWS = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 7 AS key, event_type, value, ts, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS k FROM events),
  nxt AS MATERIALIZED (SELECT a.key, a.k, a.ts, least(a.k + {_RATE}, coalesce(min(b.k), 1000000000)) AS nk FROM r a LEFT JOIN r b ON b.key = a.key AND b.k > a.k AND b.k <= a.k + {_RATE} AND b.ts >= a.ts + INTERVAL {_CADENCE_H} HOUR GROUP BY a.key, a.k, a.ts),
  w AS (SELECT key, k, ts, nk FROM nxt WHERE k = 1 UNION ALL SELECT n.key, n.k, n.ts, n.nk FROM w JOIN nxt n ON n.key = w.key AND n.k = w.nk),
  size AS (SELECT key, max(k) AS last FROM r GROUP BY key), mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS at FROM events),
  ended AS MATERIALIZED (SELECT w.key, w.k, w.ts AS started, w.nk, CASE WHEN w.nk <= last AND w.nk = w.k + {_RATE} THEN 'rows' ELSE 'time' END AS reason FROM w JOIN size USING (key), mark
    WHERE w.nk <= last OR w.ts + INTERVAL {_CADENCE_H} HOUR < mark.at),
  old AS (SELECT event_type AS l, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM events WHERE {K._EV_OLD} AND event_type <> 'error' GROUP BY 1),
  cells AS MATERIALIZED (SELECT e.key, e.started, e.reason, o.l AS cell, CAST(count(*) AS DOUBLE) AS weight FROM ended e JOIN r ON r.key = e.key AND r.k >= e.k AND r.k < e.nk LEFT JOIN old o ON o.l = r.event_type GROUP BY ALL)
"""


def _grouped_divergence(groups: str) -> str:
    """Metrics by group from a relation ``grid`` of every label and the group's others: (groups, p, c, n)."""
    base, seen, share = "(p + 1e-12)", "((c + 1e-12) / n)", "(c / n + 1e-12)"
    terms = {
        "PopulationStabilityIndex": f"({base} - greatest({seen}, 1e-12)) * ln({base} / greatest({seen}, 1e-12))",
        "KullbackLeibler": f"{base} * ln(greatest({base} / {seen}, 1e-12))",
        "JensenShannon": f"(0.5 * {base} * ln({base} / (({base} + {share}) / 2)) + 0.5 * {share} * ln({share} / (({base} + {share}) / 2))) / ln(2)",
        "WassersteinDistance": f"0.5 * abs({base} - {share})",
    }
    return " UNION ALL ".join(f"SELECT {groups}, '{m}' AS metric, round(sum({x}), 6) + 0.0 AS value FROM grid GROUP BY {groups}" for m, x in terms.items())


def _old_labels(spark: SparkSession, sf_dir: str) -> CategoricalBaseline:
    events = table(spark, sf_dir, "events")
    return CategoricalBaseline.fit(K._when(events, K._EV_OLD).where("event_type <> 'error'"), "event_type")


def _flushed(spark: SparkSession, sf_dir: str, baseline: CategoricalBaseline) -> DataFrame:
    """The ended windows of the events as a stream; errors are not in the baseline's dictionary."""
    rows = keyed.known_labels(_streamed(spark, sf_dir).withColumn("key", F.col("user_id") % 7), "event_type", baseline.labels)
    cells = replay(keyed.flush_cells(rows, "key", "ts", _RATE, _CADENCE_H * 3600, "1 hour", "event_id"), "flush")
    return cells.withColumn("key", F.col("key").cast("long")).withColumn("started", F.col("started").cast("timestamp_ntz"))


def _weights(cells: DataFrame, *by: str) -> DataFrame:
    """The weights by the windows' starts: windows of a key that begin at one time, as rows of equal times make them, are one in the SQL."""
    return cells.groupBy(*by).agg(F.sum("weight").alias("weight"))


@query("keyed_flush_windows", f"{_WINDOWS} SELECT key, started, reason, cell, weight FROM cells")
def keyed_flush_windows(spark, sf_dir):
    """Windows of a key that end after sixty rows or twelve hours: the state store's cells of each."""
    return _weights(_flushed(spark, sf_dir, _old_labels(spark, sf_dir)), "key", "started", "reason", "cell")


@query(
    "keyed_flush_drift",
    f"""{_WINDOWS}, n AS (SELECT key, started, sum(weight) AS n FROM cells GROUP BY ALL),
  grid AS MATERIALIZED (SELECT n.key, n.started, g.p, coalesce(c.weight, 0) AS c, n.n FROM n CROSS JOIN (SELECT l, p FROM old UNION ALL SELECT NULL, 0.0) g
    LEFT JOIN cells c ON c.key = n.key AND c.started = n.started AND c.cell IS NOT DISTINCT FROM g.l)
{_grouped_divergence("key, started")}""",
)
def keyed_flush_drift(spark, sf_dir):
    """The drift of every ended window against the baseline's labels."""
    baseline = _old_labels(spark, sf_dir)
    return values(keyed.score_cells(_flushed(spark, sf_dir, baseline), baseline, ["key", "started"]))


_DECAYED = f"""WITH d AS (SELECT user_id % 7 AS key, event_type, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS step FROM events), m AS (SELECT key, max(step) AS last FROM d GROUP BY key),
  old AS (SELECT event_type AS l, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM events WHERE {K._EV_OLD} AND event_type <> 'error' GROUP BY 1),
  cells AS MATERIALIZED (SELECT d.key, o.l AS cell, sum(pow(pow(0.5, 1.0 / {K._HALF_LIFE}), last - step + 1)) AS weight FROM d JOIN m USING (key) LEFT JOIN old o ON o.l = d.event_type GROUP BY ALL)
"""


def _decayed(spark: SparkSession, sf_dir: str, baseline: CategoricalBaseline) -> DataFrame:
    rows = _streamed(spark, sf_dir).withColumn("key", F.col("user_id") % 7).withColumn("step", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    updates = replay(keyed.decay_cells(keyed.known_labels(rows, "event_type", baseline.labels), "key", "step", K._HALF_LIFE), "decay")
    return keyed.latest_cells(updates).withColumn("key", F.col("key").cast("long"))


@query("keyed_decay_cells", f"{_DECAYED} SELECT key, cell, round(weight, 6) + 0.0 AS weight FROM cells")
def keyed_decay_cells(spark, sf_dir):
    return rounded(_decayed(spark, sf_dir, _old_labels(spark, sf_dir)).select("key", "cell", "weight"), "weight")


@query(
    "keyed_decay_drift",
    f"""{_DECAYED}, n AS (SELECT key, sum(weight) AS n FROM cells GROUP BY key),
  grid AS MATERIALIZED (SELECT n.key, g.p, coalesce(c.weight, 0) AS c, n.n FROM n CROSS JOIN (SELECT l, p FROM old UNION ALL SELECT NULL, 0.0) g LEFT JOIN cells c ON c.key = n.key AND c.cell IS NOT DISTINCT FROM g.l)
{_grouped_divergence("key")}""",
)
def keyed_decay_drift(spark, sf_dir):
    baseline = _old_labels(spark, sf_dir)
    return values(keyed.score_cells(_decayed(spark, sf_dir, baseline), baseline, ["key"]))


@query(
    "keyed_flush_continuous",
    f"""{_WINDOWS}, b AS (SELECT min(value) AS lo, max(value) AS hi, greatest(3, CAST(floor(log2(count(*))) + 1 AS INTEGER)) AS nb FROM events WHERE {K._EV_OLD}),
  ed AS (SELECT list_transform(range(0, nb - 2), lambda i: lo + i * ((hi - lo) / (nb - 2))) AS edges, nb FROM b)
SELECT e.key, e.started, CAST(CASE WHEN value < edges[1] THEN 0 WHEN value > edges[len(edges)] THEN nb - 1 ELSE len(list_filter(edges, lambda z: z <= value)) END AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS weight
FROM ended e JOIN r ON r.key = e.key AND r.k >= e.k AND r.k < e.nk, ed GROUP BY ALL""",
)
def keyed_flush_continuous(spark, sf_dir):
    """The same windows with the bins of a number."""
    events = table(spark, sf_dir, "events")
    baseline = ContinuousBaseline.fit(K._when(events, K._EV_OLD), "value", "Sturges")
    rows = keyed.binned(_streamed(spark, sf_dir).withColumn("key", F.col("user_id") % 7), "value", baseline)
    cells = replay(keyed.flush_cells(rows, "key", "ts", _RATE, _CADENCE_H * 3600, "1 hour", "event_id"), "flush")
    cells = cells.select(F.col("key").cast("long").alias("key"), F.col("started").cast("timestamp_ntz").alias("started"), F.col("cell").cast("int").alias("bin"), "weight")
    return _weights(cells, "key", "started", "bin")
