import datetime
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError, EmptyDatasetError, PayloadTypeError
from gaugeline.functions.segments import LabeledSegment, ThresholdSegment
from gaugeline.operators import analysis, reports
from gaugeline.operators.drift import CategoricalDataDrift, ContinuousBaseline, compute_drift_categorical_distribution
from gaugeline.plans import catalogue
from gaugeline.sources.tables import from_columns
from gaugeline.streaming import live, monitors

ONE = LabeledSegment(1)


def flipped(spark):
    return from_columns(spark, f=[1, 1, 1, 1, 0, 0, 0, 0], p=[1, 1, 1, 0, 0, 1, 0, 0], g=[1, 1, 0, 1, 1, 0, 1, 0])


def even(spark):
    return from_columns(spark, f=[1, 1, 1, 1, 0, 0, 0, 0], p=[1, 1, 0, 0, 1, 1, 0, 0], g=[1, 0, 1, 0, 1, 0, 1, 0])


def test_data_bias_monitor(spark):
    df = flipped(spark)
    m = monitors.DataBiasStreaming(df, "f", "g", ONE, ONE)
    with pytest.raises(EmptyDatasetError):
        m.performance_snapshot()
    m.push_batch(df.limit(5))
    m.push_batch(df.subtract(df.limit(0)).limit(0))
    m.flush()
    m.push_batch(df)
    want = reports.report_to_dict(analysis.data_bias_report(df, "f", "g", ONE, ONE))
    assert m.performance_snapshot() == want
    assert m.drift_report() == {"passed": True}
    m.push(1, 1)
    assert m.performance_snapshot()["ClassImbalance"] == pytest.approx(1 / 9)
    assert not m.drift_report()["passed"]
    assert m.drift_report_partial_metrics(["LpNorm"], 10.0)["passed"]
    m.reset_baseline(df)
    with pytest.raises(EmptyDatasetError):
        m.drift_snapshot()
    m.push_batch(df)
    m.reset_baseline_and_segmentation_criteria(df, LabeledSegment(0), ONE)
    m.push_batch(df)
    assert m.drift_report()["passed"]


def test_monitor_report_compares_what_its_sql_compares(spark, tmp_path):
    # the facets differ so little that divergences of either side are 0 at six places, though one is four times the other
    quarter, k = F.expr("id div 20000"), F.col("id") % 20000
    rows = spark.range(40000).select(
        F.when(quarter == 0, F.lit("1995-02-01")).otherwise("1995-08-01").cast("timestamp_ntz").alias("l_shipdate"),
        F.when(k % 2 == 0, "R").otherwise("N").alias("l_returnflag"),
        F.when(k < 10000 + 2 * F.when(k % 2 == 0, 0).otherwise(1 + quarter), 30.0).otherwise(20.0).alias("l_quantity"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(r[0] for r in con.execute(catalogue.ORACLES["monitor_drift_report"]).fetchall())
    assert want == ["DifferenceInProportionOfLabels", "KolmogorovSmirnov", "LpNorm", "TotalVariationDistance"]
    assert sorted(r["metric"] for r in catalogue.QUERIES["monitor_drift_report"](spark, str(tmp_path)).collect()) == want
    # without rounding the monitor sees the divergences too
    first = rows.where(F.quarter("l_shipdate") == 1)
    m = monitors.DataBiasStreaming(first, "l_returnflag", "l_quantity", catalogue.RETURNED, catalogue.MANY)
    m.push_batch(rows.where(F.quarter("l_shipdate") > 1))
    assert {"KlDivergence", "JsDivergence"} < {r["metric"] for r in m.drift_report(0.01)["failed_report"]}


def test_model_bias_monitor(spark):
    m = monitors.ModelBiasStreaming(even(spark), "f", "g", "p", ONE, ONE, ONE)
    m.push_batch(even(spark))
    snapshot = m.drift_snapshot()
    # zero against zero is not a number, and never fails
    assert snapshot["RecallDifference"] != snapshot["RecallDifference"]
    assert m.drift_report()["passed"]
    m.flush()
    m.push_batch(flipped(spark))
    assert not m.drift_report()["passed"]
    before = m.performance_snapshot()
    m.reset_baseline(flipped(spark))
    assert m.performance_snapshot() == before and m.drift_report()["passed"]
    m.push(1, 1, 1)
    assert sum(m.cells.values()) == 9


def test_replayed_batches_count_once(spark):
    m = monitors.DataBiasStreaming(flipped(spark), "f", "g", ONE, ONE)
    for k in (0, 0, 1, 0):
        m.push_batch(flipped(spark), k)
    assert sum(m.cells[c] for c in ("n_a", "n_d")) == 16


def test_performance_monitors(spark):
    linear = from_columns(spark, t=[1.0, 2.0, 3.0, 5.0], p=[1.5, 2.0, 2.5, 6.0])
    m = monitors.LinearRegressionStreaming(linear, "t", "p")
    for k in range(4):
        m.update_stream(*linear.collect()[k])
    assert m.performance_snapshot() == pytest.approx(reports.report_to_dict(analysis.linear_report(linear, "t", "p")))
    assert m.drift_report()["passed"]
    m.update_stream(1.0, 9.0)
    assert not m.drift_report()["passed"]
    words = from_columns(spark, t=["a", "b", "a", "b", "a", "b"], p=["a", "b", "b", "a", "a", "b"])
    b = monitors.BinaryClassificationStreaming(words, "a", "t", "p")
    b.update_stream_batch(words)
    assert b.drift_report()["passed"]
    b.update_stream("a", "b")
    assert not b.drift_report(0.01)["passed"]
    b.reset_baseline_and_label(words, "b")
    with pytest.raises(EmptyDatasetError):
        b.performance_snapshot()
    probs = from_columns(spark, t=[1.0, 0.0, 1.0, 0.0], p=[0.8, 0.3, 0.4, 0.6])
    g = monitors.LogisticRegressionStreaming(probs, "t", "p")
    g.update_stream_batch(probs)
    assert g.performance_snapshot() == pytest.approx(reports.report_to_dict(analysis.logistic_report(probs, "t", "p")))
    g.reset_baseline_and_decision_threshold(probs, 0.7)
    assert g.performance_snapshot()["Accuracy"] == 0.5


def jobs_of(spark, run):
    """How many jobs a call starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    run()
    n = len(sc.statusTracker().getJobIdsForGroup("counted"))
    sc.setJobGroup("rest", "rest")
    return n


NAN = float("nan")


def test_single_pushes_count_as_batches_do(spark):
    rows = [(1.0, 0.5), (0.0, 0.25), (0.5, 0.5), (1.0, 1.0), (0.0, 0.0), (-2.0, 3.0), (NAN, 0.5), (1.0, NAN)]
    df = spark.createDataFrame(rows, "t double, p double")
    over = ThresholdSegment(0.5, "GreaterThanEqualTo")
    base = from_columns(spark, t=[1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0], p=[1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0], h=[1, 0, 0, 0, 1, 1, 0, 0])
    made = {
        "data": lambda: monitors.DataBiasStreaming(base, "t", "p", over, over),
        "linear": lambda: monitors.LinearRegressionStreaming(base, "t", "p"),
        "logistic": lambda: monitors.LogisticRegressionStreaming(base, "t", "p", 0.5, eps=1e-3),
        "binary": lambda: monitors.BinaryClassificationStreaming(base, 1.0, "t", "p"),
    }
    for kind, make in made.items():
        one, all_rows = make(), make()
        push = one.push if kind == "data" else one.update_stream
        # the last two rows hold NaN, which segments leave to columns
        assert jobs_of(spark, lambda push=push: [push(*r) for r in rows[:-2]]) == 0
        for r in rows[-2:]:
            push(*r)
        push(None, 1.0)
        all_rows.push_batch(df)
        for c in one.cells:
            assert one.cells[c] == pytest.approx(all_rows.cells[c], nan_ok=True), (kind, c)


def test_pushes_of_other_types_are_left_to_columns(spark):
    m = monitors.DataBiasStreaming(flipped(spark), "f", "g", F.col("f") == 1, ONE)
    m.push(1, 1)
    m.push(1, 0)
    assert m.cells == {"n_a": 2, "pos_a": 1, "n_d": 0, "pos_d": 0}
    with pytest.raises(PayloadTypeError):
        monitors.DataBiasStreaming(flipped(spark), "f", "g", ONE, ONE).push("1", 1)


def test_state_outlives_the_driver(spark, tmp_path):
    df, folder = flipped(spark), str(tmp_path / "state")
    m = monitors.DataBiasStreaming(df, "f", "g", ONE, ONE)
    assert not m.load(folder)
    each = m.foreach_batch(folder)
    for k in range(3):
        each(df, k)
    again = monitors.DataBiasStreaming(df, "f", "g", ONE, ONE)
    each = again.foreach_batch(folder)
    assert again.cells == m.cells
    each(df, 2)  # replayed: it was counted before
    each(df, 3)
    assert again.cells["n_a"] + again.cells["n_d"] == 32
    # one slot cut off while it is written: the other one is whole
    shutil.rmtree(f"{folder}/{again._saves % 2}")
    third = monitors.DataBiasStreaming(df, "f", "g", ONE, ONE)
    assert third.load(folder) and third.cells["n_a"] + third.cells["n_d"] in (24, 32)
    with pytest.raises(BaselineError):
        monitors.LinearRegressionStreaming(from_columns(spark, t=[1.0, 2.0], p=[1.0, 2.0]), "t", "p").load(folder)


def test_drift_state_outlives_the_driver(spark, tmp_path, monkeypatch):
    now = [100.0]
    monkeypatch.setattr(monitors.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(monitors.time, "time", lambda: now[0])
    base, folder = from_columns(spark, v=list("aabbc")), str(tmp_path / "state")
    m = monitors.StreamingCategoricalDataDriftFlush(base, "v", flush_cadence=50)
    now[0] = 110.0
    m.foreach_batch(state=folder)(from_columns(spark, v=["a", "z", "b"]), 0)
    now[0] = 130.0
    again = monitors.StreamingCategoricalDataDriftFlush(base, "v", flush_cadence=50)
    assert again.load(folder) and again.bins == m.bins and again.total_samples == 3 and again.last_flush() == 30
    with pytest.raises(BaselineError):
        monitors.StreamingCategoricalDataDriftFlush(from_columns(spark, v=list("ax")), "v").load(folder)


def test_epsilon_of_drift_monitors(spark):
    base, now = from_columns(spark, v=list("aabb")), from_columns(spark, v=list("aaaa"))
    for eps in (1e-12, 1e-3):
        m = monitors.StreamingCategoricalDataDriftFlush(base, "v", eps=eps)
        m.update_stream_batch(now)
        names = ["PopulationStabilityIndex", "KullbackLeibler", "JensenShannon", "WassersteinDistance"]
        assert m.compute_drift_multiple_criteria(names) == pytest.approx(compute_drift_categorical_distribution(base, now, "v", names, eps=eps))
        assert CategoricalDataDrift(base, "v", eps).compute_drift_multiple_criteria(now, names) == pytest.approx(compute_drift_categorical_distribution(base, now, "v", names, eps=eps))


def test_flush_by_rate(spark):
    base = from_columns(spark, v=[float(x) for x in range(20)])
    m = monitors.StreamingContinuousDataDriftFlush(base, "v", flush_rate=3)
    for x in range(7):
        m.update_stream(float(x))
    assert m.total_samples == 1
    batch = spark.createDataFrame([(i, float(i)) for i in range(7)], "k int, v double")
    n = monitors.StreamingContinuousDataDriftFlush(base, "v", flush_rate=3)
    n.update_stream_batch(batch, order="k")
    assert n.bins == m.bins and n.total_samples == 1
    with pytest.raises(ValueError, match="order"):
        n.update_stream_batch(batch)
    n.flush()
    assert n.is_empty() and n.last_flush() == 0
    with pytest.raises(EmptyDatasetError):
        n.compute_drift("JensenShannon")
    with pytest.raises(EmptyDatasetError):
        n.export_snapshot()


def test_flush_by_cadence(spark, monkeypatch):
    base = from_columns(spark, v=list("aabbc"))
    now = [0.0]
    monkeypatch.setattr(monitors.time, "monotonic", lambda: now[0])
    m = monitors.StreamingCategoricalDataDriftFlush(base, "v", flush_cadence=10)
    m.update_stream("a")
    now[0] = 11.0
    m.update_stream("b")  # the clock is read only when the size divides evenly
    assert m.total_samples == 2 and m.last_flush() == 11
    m.update_stream_batch(from_columns(spark, v=["z", "a"]))
    assert m.total_samples == 2 and m.last_flush() == 0
    assert m.export_snapshot() == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert m.num_bins == 4


def test_decay(spark):
    base = from_columns(spark, v=[float(x) for x in range(100)])
    m = monitors.StreamingContinuousDataDriftDecay(base, "v", decay_half_life=1)
    m.update_stream_batch(base)
    m.compute_drift("WassersteinDistance")
    assert m.total_samples == 50
    m.compute_drift_multiple_criteria(["WassersteinDistance", "JensenShannon"])
    assert m.total_samples == 25
    snap = m.export_snapshot()
    assert snap["streamBins"] == pytest.approx(snap["baselineBins"]) and len(snap["binEdges"]) == m.num_bins - 2
    c = monitors.StreamingCategoricalDataDriftDecay(from_columns(spark, v=list("ab")), "v", 1)
    c.update_stream("q")
    assert c.compute_drift("WassersteinDistance") == pytest.approx(1)
    c.reset_baseline(from_columns(spark, v=list("abc")))
    assert c.is_empty() and c.export_baseline() == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})


def stream_of(spark, tmp_path, batches):
    schema = batches[0].schema
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_foreach_batch(spark, tmp_path):
    df = flipped(spark)
    m = monitors.DataBiasStreaming(df, "f", "g", ONE, ONE)
    q = stream_of(spark, tmp_path, [df.limit(3), df]).writeStream.foreachBatch(m.foreach_batch()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert m.cells["n_a"] + m.cells["n_d"] == 11


def events(spark, n=40):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(start + datetime.timedelta(hours=i), i % 2, float(i)) for i in range(n)], "ts timestamp, f int, v double")


def test_windows_on_batches_and_streams(spark, tmp_path):
    df = events(spark)
    half = ThresholdSegment(20.0, "GreaterThanEqualTo")
    batch = live.windowed_data_bias(df, "ts", "1 day", "f", "v", ONE, half)
    want = {(r["window"]["start"], r["metric"]): r["value"] for r in batch.where("metric = 'ClassImbalance'").collect()}
    out = live.windowed_data_bias(stream_of(spark, tmp_path, [df]), "ts", "1 day", "f", "v", ONE, half, watermark="1 hour")
    q = out.where("metric = 'ClassImbalance'").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    got = {(r["window"]["start"], r["metric"]): r["value"] for r in spark.table("win").collect()}
    assert got == want and len(want) == 2
    assert live.windowed_counts(df, "ts", "1 day", "12 hours").count() == 5
    assert live.windowed_linear(df.withColumn("p", F.col("v") + 1), "ts", "1 day", "v", "p").where("metric = 'MaxError'").select("value").distinct().first()[0] == 1
    assert live.windowed_model_bias(df.withColumn("g", F.col("f")), "ts", "1 day", "f", "g", "v", ONE, ONE, half).count() == 24


@pytest.mark.parametrize("mode", ["flush", "decay"])
def test_live_drift(spark, tmp_path, mode):
    base = ContinuousBaseline.fit(from_columns(spark, v=[float(x) for x in range(100)]), "v")
    rows = [spark.createDataFrame([("a", i, float(i)) for i in range(k, k + 5)], "key string, k int, v double") for k in (0, 5)]
    out = live.live_drift(stream_of(spark, tmp_path, rows), "key", "v", base, mode, rate=4, order="k", half_life=1.0)
    seen = []
    q = out.writeStream.foreachBatch(lambda d, _: seen.extend(d.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    # flush at 4: 5 rows leave 1, 10 rows leave 2; decay: 5 -> 2.5, (2.5 + 5) / 2
    assert [r["samples"] for r in seen] == ([1, 2] if mode == "flush" else [2.5, 3.75])


def test_flush_windows(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(23)], "a int, b int")
    got = {(r.a, r.b): r.flush_window for r in live.flush_windows(df, ["a", "b"], 4).collect()}
    for i, k in enumerate(sorted(got)):
        assert got[k] == i // 4
    by = live.flush_windows(df, ["b"], 2, by=["a"]).groupBy("a").agg(F.max("flush_window").alias("m")).collect()
    assert {r.m for r in by} == {1, 2}


def test_decayed_histogram(spark):
    df = spark.createDataFrame([(0, "x"), (0, "x"), (1, "x"), (1, "y")], "step int, bin string")
    got = {r["bin"]: r["c"] for r in live.decayed_histogram(df, "step", "bin", 1, 1.0).collect()}
    assert got == {"x": 2 * 0.25 + 0.5, "y": 0.5}


def test_sessions(spark):
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + datetime.timedelta(minutes=m)) for m in (0, 3, 20, 21, 22)], "k string, ts timestamp")
    assert sorted(r.n for r in live.session_counts(df, "ts", "10 minutes", ("k",)).collect()) == [2, 3]


def test_delayed_labels(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    pred = spark.createDataFrame([(1, 0.5, at(0)), (2, 0.7, at(0)), (3, 0.1, at(1))], "id long, p double, pt timestamp")
    truth = spark.createDataFrame([(1, 1, at(2)), (2, 0, at(30)), (4, 1, at(1))], "id long, t int, lt timestamp")
    assert live.join_labels(pred, truth, "id").count() == 2
    assert [r.id for r in live.join_labels(pred, truth, "id", "pt", "lt", "1 day").collect()] == [1]
    streams = [stream_of(spark, tmp_path / n, [d]) for n, d in (("p", pred), ("t", truth))]
    seen = []
    q = live.join_labels(*streams, "id", "pt", "lt", "1 day").writeStream.foreachBatch(lambda d, _: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert [r.id for r in seen] == [1]
