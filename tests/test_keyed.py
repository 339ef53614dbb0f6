"""Delayed labels, cell logs, monitors by key, and keyed windows and decay, against versions with plain loops."""

import math
import os
import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError
from gaugeline.functions.metrics import DATA_BIAS
from gaugeline.operators import analysis
from gaugeline.operators.drift import CategoricalBaseline, ContinuousBaseline
from gaugeline.plans import catalogue
from gaugeline.streaming import keyed, labels, shared
from gaugeline.streaming.celllog import CellLog, KeyedMonitor
from gaugeline.streaming.shared import replay

START = datetime(2024, 3, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def stream_of(spark, folder, batches, schema):
    """A stream that reads one list of rows after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in os.listdir(folder):
            if f.endswith(".parquet") and os.stat(f"{folder}/{f}").st_mtime > 2_000_000:
                os.utime(f"{folder}/{f}", (1_000_000 + i, 1_000_000 + i))
    kind = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))


# ---- delayed labels

P_SCHEMA, T_SCHEMA = "k long, p_at timestamp, guess boolean", "k long, t_at timestamp, truth boolean"


def brute_changes(predictions, truths, within=10, grace=60):
    first = {}
    for k, t, truth in truths:
        if k is not None and t is not None and (k not in first or t < first[k][0]):
            first[k] = (t, truth)
    out = []
    for k, p, guess in predictions:
        if p is None:
            continue
        t, truth = first.get(k, (None, None))
        gap = None if t is None else t - p
        if gap is not None and 0 <= gap <= within:
            out.append((k, guess, truth, "labelled", 1))
        else:
            out.append((k, guess, None, "unlabelled", 1))
            if gap is not None and within < gap <= grace:
                out += [(k, guess, None, "unlabelled", -1), (k, guess, truth, "late", 1)]
    return Counter(out)


def tables(spark, predictions, truths):
    return (spark.createDataFrame([(k, at(p), g) for k, p, g in predictions], P_SCHEMA), spark.createDataFrame([(k, at(t), x) for k, t, x in truths], T_SCHEMA))


def changes_of(df):
    return Counter((r.k, r.guess, r.truth, r.status, r.change) for r in df.collect())


PREDICTIONS = [(1, 0, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 4, False), (6, 5, True), (None, 6, True), (7, None, True), (1, 8, False), (1, 8, False), (8, 20, None)]
TRUTHS = [(1, 5, True), (2, 11, False), (3, 30, True), (4, 63, True), (5, 3, True), (None, 6, True), (9, 9, True), (6, None, True), (8, 21, None)]


def test_label_changes_of_batches(spark):
    got = labels.label_changes(*tables(spark, PREDICTIONS, TRUTHS), "k", "p_at", "t_at", "10 minutes", "60 minutes")
    want = brute_changes(PREDICTIONS, TRUTHS)
    assert changes_of(got) == want
    # a label at the last moment, one a moment later, one beyond grace, one before its prediction
    assert want[2, True, False, "labelled", 1] == 1 and want[3, False, True, "late", 1] == 1 and want[4, True, True, "late", 1] == 1 and want[5, False, None, "unlabelled", 1] == 1
    alone = labels.label_changes(*tables(spark, PREDICTIONS, TRUTHS), "k", "p_at", "t_at", "10 minutes")
    assert changes_of(alone) == Counter({k: n for k, n in want.items() if k[3] == "labelled" or k[3:] == ("unlabelled", 1)})


def test_label_changes_are_random_tables_changes(spark):
    rng = random.Random(3)
    p = [(rng.randrange(40), rng.randrange(100), rng.random() < 0.5) for _ in range(120)]
    t = [(rng.randrange(40), rng.randrange(150), rng.random() < 0.5) for _ in range(60)]
    t = list({(k, m): (k, m, x) for k, m, x in t}.values())  # one truth a key and time
    assert changes_of(labels.label_changes(*tables(spark, p, t), "k", "p_at", "t_at", "10 minutes", "60 minutes")) == brute_changes(p, t)


def test_earliest_label_counts_and_columns_must_differ(spark):
    p, t = tables(spark, [(1, 0, True)], [(1, 9, False), (1, 3, True), (1, 50, False)])
    assert changes_of(labels.label_changes(p, t, "k", "p_at", "t_at", "10 minutes", "60 minutes")) == Counter({(1, True, True, "labelled", 1): 1})
    with pytest.raises(ValueError, match="guess"):
        labels.label_changes(p, t.withColumn("guess", F.lit(1)), "k", "p_at", "t_at", "10 minutes")
    empty = labels.label_changes(p.limit(0), t.limit(0), "k", "p_at", "t_at", "10 minutes", "60 minutes")
    assert empty.count() == 0


def test_label_stream_with_late_and_missing_labels(spark, tmp_path):
    p = [[(1, 0, True), (2, 1, True), (3, 2, False)], [(4, 40, True)], [(5, 200, True)], [(6, 400, False)]]
    t = [[(1, 5, True)], [(3, 35, True)], [(4, 45, False), (5, 201, True)], [(9, 401, True)]]
    streams = [
        stream_of(spark, tmp_path / name, [[(k, at(m), x) for k, m, x in rows] for rows in batches], schema)
        for name, batches, schema in (("p", p, P_SCHEMA), ("t", t, T_SCHEMA))
    ]
    out = replay(labels.label_changes(*streams, "k", "p_at", "t_at", "10 minutes", "60 minutes", delay="30 minutes"), "labels")
    flat = [x for rows in p for x in rows], [x for rows in t for x in rows]
    # the last prediction's time is not over at the last watermark
    want = brute_changes([x for x in flat[0] if x[0] != 6], flat[1])
    assert changes_of(out) == want
    cells = labels.changed_cells(out, F.col("truth"), F.col("guess")).first().asDict()
    assert cells == {"tp": 2, "fp": 1, "tn": 0, "fn": 1, "unlabelled": 1}


# ---- logs of cells


def test_log_counts_every_batch_once(spark, tmp_path):
    log = CellLog(spark, f"{tmp_path}/log", ["k"], ["n", "max_x"])
    assert log.is_empty()
    with pytest.raises(BaselineError):
        log.read()
    part = lambda *rows: spark.createDataFrame(rows, "k string, n long, max_x double")
    log.append(part(("a", 1, 2.0), ("b", 5, 1.0)), 0)
    log.append(part(("a", 9, 9.0)), 1)
    log.append(part(("a", 2, 1.0), (None, 1, 0.0)), 1)  # run again, with what it gives now
    want = [(None, 1, 0.0), ("a", 3, 2.0), ("b", 5, 1.0)]
    rows = lambda: sorted((tuple(r) for r in log.read().collect()), key=lambda r: (r[0] is not None, r[0]))
    assert rows() == want
    log.compact()
    log.append(part(("a", 100, 100.0)), 1)  # merged already
    assert rows() == want
    log.append(part(("b", 1, 7.0)), 2)
    log.compact()
    log.compact()
    log.append(part(("c", 1, 7.0)), 3)
    log.compact()
    want = [(None, 1, 0.0), ("a", 3, 2.0), ("b", 6, 7.0), ("c", 1, 7.0)]
    assert rows() == want
    # a write that was cut off has no mark and does not count
    os.makedirs(f"{tmp_path}/log/batches/9")
    os.makedirs(f"{tmp_path}/log/merged/9")
    part(("a", 7, 7.0)).write.mode("overwrite").parquet(f"{tmp_path}/log/batches/8")
    os.remove(f"{tmp_path}/log/batches/8/_SUCCESS")
    assert rows() == want
    assert sorted(CellLog(spark, f"{tmp_path}/log", ["k"], ["n", "max_x"]).read().collect()[0].asDict()) == ["k", "max_x", "n"]


def facets(df, by):
    return analysis.facet_counts(df, F.col("f") == "x", F.col("g") > 0, by)


ROWS = "key string, day timestamp, f string, g int"


def test_rows_meet_the_baseline_of_their_time(spark, tmp_path):
    rng = random.Random(1)
    row = lambda k, m: (k, at(m), rng.choice("xy"), rng.choice([0, 1, 1]))
    old, new = [row(k, 0) for k in "ab" for _ in range(30)], [row("a", 0) for _ in range(30)]
    monitor = KeyedMonitor(spark, f"{tmp_path}/m", DATA_BIAS, ["key"], "day", facets)
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    monitor.reset_baseline(frame(old + [(None, at(0), "x", 1)]), "2024-03-01 00:10:00", 0)
    monitor.reset_baseline(frame(new), "2024-03-01 01:00:00", 1)
    batches = [[row(rng.choice("abc"), rng.choice([5, 10, 59, 60, 90, None])) for _ in range(80)] for _ in range(3)]
    batches[1] += [(None, at(20), "x", 1), ("a", at(20), None, 1)]
    for i, rows in enumerate(batches):
        monitor.push_batch(frame(rows), i)
    KeyedMonitor(spark, f"{tmp_path}/m", DATA_BIAS, ["key"], "day", facets).push_batch(frame(batches[2]), 2)

    want = defaultdict(Counter)
    for k, day, f, g in (r for rows in batches for r in rows):
        if k in ("a", "b") and day is not None and day >= at(10) and f is not None:
            version = 1 if k == "a" and day >= at(60) else 0
            side = "a" if f == "x" else "d"
            want[k, version].update({f"n_{side}": 1, f"pos_{side}": int(g > 0)})
    got = {(r["key"], r["version"]): r for r in monitor.runtime.read().collect()}
    assert got.keys() == want.keys()
    assert all(got[k][c] == want[k][c] for k in want for c in ("n_a", "pos_a", "n_d", "pos_d"))
    # each version is compared with its own baseline, by the family's formulas
    name = "DifferenceInProportionOfLabels"
    share = lambda c: c["pos_a"] / c["n_a"] - c["pos_d"] / c["n_d"]
    base = {(r["key"], r["version"]): share(r) for r in monitor.baselines.read().collect()}
    drift = {(r["key"], r["version"]): r["value"] for r in monitor.drift([name]).collect()}
    assert drift.keys() == want.keys()
    for k, v in drift.items():
        assert v == pytest.approx(abs(share(want[k]) - base[k]) / abs(base[k]))
    failed = {(r["key"], r["version"]) for r in monitor.failures(1e-9, [name]).collect()}
    assert failed == {("a", 1), ("b", 0)} & {k for k, v in drift.items() if v >= 1e-9}


def test_reset_starts_some_keys_anew(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    monitor = KeyedMonitor(spark, f"{tmp_path}/m", DATA_BIAS, ["key"], "day", facets)
    monitor.reset_baseline(frame([(k, at(0), f, 1) for k in "ab" for f in "xy"]), "2024-01-01", 0)
    monitor.push_batch(frame([(k, at(0), "x", 1) for k in "ab"]), 0)
    monitor.reset(frame([("b", None, None, None)]), "2024-03-01 00:30:00", 1)
    monitor.push_batch(frame([(k, at(m), "x", 1) for k in "ab" for m in (0, 30)]), 1)
    got = {(r["key"], r["version"]): r["n_a"] for r in monitor.runtime.read().collect()}
    assert got == {("a", 0): 3, ("b", 0): 2, ("b", 1): 1}
    base = {(r["key"], r["version"]): r["n_a"] for r in monitor.baselines.read().collect()}
    assert base == {("a", 0): 1, ("b", 0): 1, ("b", 1): 1}
    with pytest.raises(ValueError):
        KeyedMonitor(spark, str(tmp_path), "nothing", ["key"], "day", facets)


def test_monitor_by_key_on_a_stream(spark, tmp_path):
    monitor = KeyedMonitor(spark, f"{tmp_path}/m", DATA_BIAS, ["key"], "day", facets)
    monitor.reset_baseline(spark.createDataFrame([("a", at(0), f, 1) for f in "xy"], ROWS), "2024-01-01", 0)
    stream = stream_of(spark, tmp_path / "in", [[("a", at(i), "x", i % 2)] for i in range(3)], ROWS)
    stream.writeStream.foreachBatch(monitor.foreach_batch()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert monitor.runtime._numbers("batches") == [0, 1, 2]
    assert [(r["n_a"], r["pos_a"]) for r in monitor.runtime.read().collect()] == [(3, 1)]


# ---- windows and decay by key

E_SCHEMA = "id long, key string, t timestamp, label string"


def brute_windows(rows, rate, minutes, end):
    """Windows of rows (id, key, minute, label) in order of time, and those that are ended at the minute ``end``."""
    out, open_ = Counter(), {}

    def close(key, reason):
        started, labels_ = open_.pop(key)
        out.update({(key, at(started), reason, c, float(n)): 1 for c, n in Counter(labels_).items()})

    for _, key, m, label in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        if key in open_ and len(open_[key][1]) >= rate:
            close(key, "rows")
        elif key in open_ and m - open_[key][0] >= minutes:
            close(key, "time")
        open_.setdefault(key, (m, []))[1].append(label)
    for key, (started, _) in list(open_.items()):
        if started + minutes < end:
            close(key, "time")
    return out


def windows_of(df):
    return Counter((r.key, r.started, r.reason, r.cell, r.weight) for r in df.collect())


@pytest.mark.parametrize("files", [1, 4])
def test_windows_end_by_rows_and_by_time(spark, tmp_path, files):
    rng = random.Random(files)
    minutes = sorted(rng.randrange(600) for _ in range(300))
    rows = [(i, rng.choice(["a", "a", "b", None]), m, rng.choice(["x", "y", "z", None])) for i, m in enumerate(minutes)]
    rows += [(1000, "silent", 5, "x"), (1001, "late", 590, "x"), (1002, "b", None, "x")]
    rows.sort(key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    cut = [rows[len(rows) * k // files : len(rows) * (k + 1) // files] for k in range(files)]
    stream = stream_of(spark, tmp_path / "in", [[(i, k, at(m), c) for i, k, m, c in part] for part in cut], E_SCHEMA)
    known = spark.createDataFrame([("x",), ("y",)], "label string")
    out = replay(keyed.flush_cells(keyed.known_labels(stream, "label", known), "key", "t", 7, 45 * 60, "0 seconds", "id"), "w")
    seen = [(i, k, m, c if c in ("x", "y") else None) for i, k, m, c in rows if c is not None]
    assert windows_of(out) == brute_windows(seen, 7, 45, max(r[2] for r in seen if r[2] is not None))
    assert ("silent", at(5), "time", "x", 1.0) in windows_of(out)


class Store:
    """A state store of one key in memory, which counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.cells, self.timers = 0, None, {}, set()

    def getMapState(self, *_):
        def update(k, v):
            self.calls += 1
            self.cells[k] = v

        def get(k):
            self.calls += 1
            return self.cells.get(k)

        return SimpleNamespace(getValue=get, updateValue=update, iterator=lambda: iter(self.cells.items()), clear=self.cells.clear)

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def listTimers(self):
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


@pytest.mark.parametrize(("batches", "block", "rate"), [(1, 200_000, 7), (3, 20, 7), (5, 1, 1), (40, 10, 7), (2, 50, 10**6)])
def test_windows_of_a_batch_do_not_ask_the_state_store(batches, block, rate, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCK", block, raising=False)
    rng = random.Random(batches)
    rows = [(i, "a", m, rng.choice(["x", "y", None])) for i, m in enumerate(sorted(rng.randrange(3000) for _ in range(900)))]
    micros = lambda m: int((at(m) - datetime(1970, 1, 1)).total_seconds()) * 10**6
    store, got = Store(), Counter()
    processor = keyed.WindowProcessor(rate, 45 * 60)
    processor.init(store)

    def add(frames):
        for f in frames:
            got.update((k, s.tz_localize(None).to_pydatetime(), r, None if pd.isna(c) else c, w) for k, s, r, c, w in zip(f["key"], f["started"], f["reason"], f["cell"], f["weight"], strict=True))

    for k in range(batches):
        part = rows[len(rows) * k // batches : len(rows) * (k + 1) // batches]
        frame = pd.DataFrame({"at": [micros(m) for _, _, m, _ in part], "turn": [i for i, *_ in part], "cell": pd.Series([c for *_, c in part], dtype=object)}).sample(frac=1, random_state=k)
        add(processor.handleInputRows(("a",), iter([frame.iloc[:9], frame.iloc[9:]]), None))
    add(processor.handleExpiredTimer(("a",), None, None))
    assert got == brute_windows(rows, rate, 45, 10**6)
    # two windows of three cells a batch at most, read and written
    assert store.calls <= batches * 2 * 3 * 2


def test_rows_without_a_turn_are_the_last_of_their_time(spark, tmp_path):
    rows = [(None, "a", at(1), "z"), (2**60 + 1, "a", at(1), "y"), (2**60, "a", at(1), "x"), (5, "a", at(500), "x"), (6, "b", at(900), "x")]
    stream = stream_of(spark, tmp_path / "in", [rows], E_SCHEMA).withColumn("cell", F.col("label"))
    out = replay(keyed.flush_cells(stream, "key", "t", 1, 60 * 60, "0 seconds", "id"), "w")
    assert [r.cell for r in sorted(out.where("reason = 'rows'").collect(), key=lambda r: r.cell)] == ["x", "y", "z"]
    pairs = replay(keyed.flush_cells(stream, "key", "t", 2, 60 * 60, "0 seconds", "id"), "w").where("started = '2024-03-01 00:01:00'")
    assert {(r.cell, r.reason) for r in pairs.collect()} == {("x", "rows"), ("y", "rows"), ("z", "time")}


@pytest.mark.parametrize("name", ["keyed_flush_windows", "keyed_flush_drift", "keyed_flush_continuous"])
def test_windows_that_begin_at_one_time_are_one_as_in_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT k * 130 + i AS event_id, TIMESTAMP '2024-01-10' + to_hours(CAST(k AS INTEGER)) AS ts, k % 2 AS user_id,
      ['view', 'click', 'error'][1 + (k + i // 50) % 3] AS event_type, CAST((k * 7 + i) % 90 AS DOUBLE) AS value FROM range(8) a(k), range(130) b(i) WHERE k < 6 OR i < 90
      UNION ALL SELECT 5000 + m, TIMESTAMP '2024-01-20' + to_days(CAST(m AS INTEGER)), m % 3, 'view', 5.0 FROM range(6) c(m)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    want = Counter(con.sql(catalogue.ORACLES[name]).select(", ".join(df.columns)).fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want and max(want.values()) == 1
    if name == "keyed_flush_windows":
        # two windows of sixty rows begin with the first of 130 rows of one time
        assert max(w for *_, w in want) > 60 and {r for _, _, r, _, _ in want} == {"rows", "time"}


def test_late_rows_and_the_wall_clock(spark, tmp_path):
    # a row from before a window's first one still counts in it; one behind the watermark does not
    # (Spark drops by the watermark of the batch before)
    batches = [[(1, "a", at(100), "x")], [(2, "a", at(95), "y")], [(3, "a", at(20), "y")], [(4, "a", at(200), "x")], [(5, "b", at(500), "x")]]
    stream = stream_of(spark, tmp_path / "in", batches, E_SCHEMA).withColumn("cell", F.col("label"))
    out = replay(keyed.flush_cells(stream, "key", "t", 100, 60 * 60, "10 minutes", "id"), "w")
    assert windows_of(out) == Counter({("a", at(100), "time", "x", 1.0): 1, ("a", at(100), "time", "y", 1.0): 1, ("a", at(200), "time", "x", 1.0): 1})
    # by the wall clock a batch is a moment, and the stream goes on for its timers until it is stopped
    walls = keyed.flush_cells(stream, "key", "t", 2, 1e-3, order="id", clock="processing")
    query = walls.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start(f"{tmp_path}/walls")
    got, until = Counter(), time.monotonic() + 60
    while sum(got.values()) < 5 and time.monotonic() < until and query.isActive:
        time.sleep(1)
        if os.path.isdir(f"{tmp_path}/walls/_spark_metadata"):
            got = Counter((r.key, r.reason, r.cell, r.weight) for r in spark.read.schema(walls.schema).parquet(f"{tmp_path}/walls").collect())
    query.stop()
    assert got == Counter({("a", "time", "x", 1.0): 2, ("a", "time", "y", 1.0): 2, ("b", "time", "x", 1.0): 1})
    with pytest.raises(ValueError, match="clock"):
        keyed.flush_cells(stream, "key", "t", clock="none")


def brute_decay(rows, half_life):
    factor = 0.5 ** (1 / half_life)
    last = {}
    for key, step, _ in rows:
        last[key] = max(step, last.get(key, step))
    out = defaultdict(float)
    for key, step, cell in rows:
        out[key, cell] += factor ** (last[key] - step + 1)
    return out


@pytest.mark.parametrize("smallest", [1e-120, 0.5])
def test_decay_does_not_depend_on_the_order_of_batches(spark, tmp_path, smallest, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(9), rng.choice(["x", "y", None])) for _ in range(200)] + [("once", 3, "x")]
    half = 1.5
    schema = "key string, step int, cell string"
    orders = [sorted(rows, key=lambda r: r[1]), sorted(rows, key=lambda r: -r[1]), rng.sample(rows, len(rows))]
    for k, order in enumerate(orders):
        parts = [order[len(order) * i // 3 : len(order) * (i + 1) // 3] for i in range(3)]
        monkeypatch.setattr(keyed, "SMALLEST", smallest)
        stream = stream_of(spark, tmp_path / str(k), parts, schema)
        out = keyed.latest_cells(replay(keyed.decay_cells(stream, "key", "step", half), "d"))
        got = {(r.key, r.cell): r.weight for r in out.collect()}
        want = brute_decay(rows, half)
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
        sizes = {r.key: r.size for r in out.collect()}
        assert all(sizes[key] == pytest.approx(sum(v for (q, _), v in want.items() if q == key)) for key in sizes)


def test_scores_of_cells_are_those_of_rows(spark):
    rng = random.Random(2)
    base = spark.createDataFrame([(rng.choice("abcdef"), rng.random()) for _ in range(300)], "label string, v double")
    rows = spark.createDataFrame([(rng.choice("xy"), rng.choice("abcq"), rng.random() * 1.2 - 0.1) for _ in range(200)], "g string, label string, v double")
    labels_ = CategoricalBaseline.fit(base, "label")
    cells = keyed.known_labels(rows, "label", labels_.labels).groupBy("g", "cell").agg(F.count("*").cast("double").alias("weight"))
    pairs = lambda df: {(r.g, r.metric): r.value for r in df.collect()}
    got, want = pairs(keyed.score_cells(cells, labels_, ["g"])), pairs(labels_.score(rows, "label", by=["g"]))
    assert len(want) == 8 and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    bins = ContinuousBaseline.fit(base, "v", "Sturges")
    cells = keyed.binned(rows, "v", bins).groupBy("g", "cell").agg(F.count("*").cast("double").alias("weight"))
    got, want = pairs(keyed.score_cells(cells, bins, ["g"])), pairs(bins.score(rows, "v", by=["g"]))
    assert len(want) == 8 and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_shared_folder_must_be_shared(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_folder(Session(), "x")
