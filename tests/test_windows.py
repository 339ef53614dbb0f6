"""Sliding windows by panes, numbering in ranges and dictionaries as tables, against brute force."""

import datetime
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError, EmptyDatasetError
from gaugeline.operators import analysis, numbering
from gaugeline.operators.drift import CategoricalBaseline
from gaugeline.operators.numbering import number_rows
from gaugeline.streaming import live, panes
from gaugeline.streaming.dictionary import DictionaryMonitor
from gaugeline.streaming.monitors import StreamingContinuousDataDriftFlush

START = datetime.datetime(2024, 3, 1)
CELLS = ["n", "total", "max_x", "min_x"]


def counted(df, by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("max_x"), F.min("x").alias("min_x"))


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def scattered(n=400):
    """Times with gaps longer than any window, many at one time, before and after 1970, some missing; keys with nulls."""
    rows = []
    for i in range(n):
        m = (i * i * 7) % 5000 if i % 3 else (i % 7) * 60
        when = None if i % 50 == 49 else at(m) if i % 11 else datetime.datetime(1969, 12, 30) + datetime.timedelta(minutes=m)
        rows.append((None if i % 13 == 0 else f"k{i % 3}", when, float((i * 37) % 101)))
    return rows


@pytest.mark.parametrize(("duration", "slide"), [("60 minutes", "15 minutes"), ("50 minutes", "20 minutes"), ("7 minutes", "7 minutes"), ("30 minutes", "29 minutes"), ("3 days", "1 hour")])
def test_sliding_cells_as_by_copied_rows(spark, duration, slide):
    """The same windows and cells as ``functions.window`` gives by copying rows."""
    df = spark.createDataFrame(scattered(), "k string, ts timestamp, x double").repartition(3)
    got = panes.sliding_cells(df, "ts", duration, slide, counted, ["k"])
    want = counted(df.withColumn("window", F.window("ts", duration, slide)), ["k", "window"])
    pick = lambda d: Counter(tuple(r) for r in d.select("k", "window.start", "window.end", *CELLS).collect())
    assert pick(got) == pick(want)
    whole = panes.sliding_counts(df, "ts", duration, slide)
    assert {r["window"]["start"]: r["n"] for r in whole.collect()} == {r["window"]["start"]: r["n"] for r in live.windowed_counts(df, "ts", duration, slide).collect()}


def test_fractions_keep_their_digits(spark):
    """A huge value leaves the windows after it as they are, as do infinities and NaN."""
    rows = [("a", at(0), 1e300), ("a", at(1), float("inf")), ("a", at(2), float("nan")), ("a", at(10), 0.1), ("a", at(11), 0.2)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double")
    got = {r["window"]["start"]: r for r in panes.sliding_cells(df, "ts", "4 minutes", "1 minute", counted, ["k"]).collect()}
    assert got[at(8)]["total"] == 0.1 + 0.2 and got[at(10)]["total"] == 0.1 + 0.2 and got[at(11)]["total"] == 0.2
    assert math.isnan(got[at(0)]["total"]) and got[at(-3)]["total"] == 1e300 and got[at(-2)]["total"] == float("inf")
    assert at(5) not in got


def test_panes_of_odd_tables(spark):
    rows = [("a", at(0), 1.0), ("a", at(0), None), (None, None, 2.0)]
    df = spark.createDataFrame(rows, "start string, block timestamp, turn double")
    count = lambda d, by: d.groupBy(*by).agg(F.count("*").alias("tail"), F.sum("turn").alias("_at"))
    out = panes.sliding_cells(df, "block", "2 minutes", "1 minute", count, ["start"])
    assert out.columns == ["start", "window", "tail", "_at"]
    assert sorted((r[0], r[1]["start"], r[2], r[3]) for r in out.collect()) == [("a", at(-1), 2, 1.0), ("a", at(0), 2, 1.0)]
    assert panes.sliding_cells(df.where("false"), "block", "2 minutes", "1 minute", count, ["start"]).count() == 0
    for duration, slide in (("1 minute", "2 minutes"), ("1 minute", "0 minutes")):
        with pytest.raises(ValueError):
            panes.sliding_counts(df, "block", duration, slide)


def test_panes_written_in_parts(spark):
    """Panes of several batches add up, whatever batch a row came with."""
    df = spark.createDataFrame(scattered(), "k string, ts timestamp, x double")
    part = [panes.pane_cells(df.where(F.pmod(F.xxhash64("x"), F.lit(3)) == i), "ts", "60 minutes", "15 minutes", counted, ["k"]) for i in range(3)]
    got = panes.window_cells(part[0].unionByName(part[1]).unionByName(part[2]), "60 minutes", "15 minutes", ["k"])
    want = panes.sliding_cells(df, "ts", "60 minutes", "15 minutes", counted, ["k"])
    pick = lambda d: Counter(tuple(r) for r in d.select("k", "window.start", *CELLS).collect())
    assert pick(got) == pick(want)


def _rows_through_exchanges(df):
    """Rows written by each exchange of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_one_row_a_pane_in_the_exchange(spark):
    """Thirty days by day over 60 days of 200 rows each: no exchange passes the rows, or a pane for each of its windows."""
    df = spark.range(0, 60 * 200, 1, 2).select(F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") % 60 * 86400 + F.col("id") % 977).alias("ts"), (F.col("id") % 7).alias("v"))
    out = panes.sliding_linear(df, "ts", "30 days", "1 day", "v", "v")
    assert len({r["window"]["start"] for r in out.collect()}) == 89
    passed = _rows_through_exchanges(out)
    # 60 panes from two partitions, then each pane in two roles
    assert len(passed) == 2 and max(passed) <= 120


# ---- numbering -------------------------------------------------------------------------------------------------


def numbers(df, key, name="number"):
    held = defaultdict(list)
    for r in df.collect():
        held[key(r)].append(r)
    for rows in held.values():
        rows.sort(key=lambda r: r[name])
        assert [r[name] for r in rows] == list(range(len(rows)))
    return held


@pytest.mark.parametrize("unique", [True, False])
def test_numbers_by_group(spark, unique):
    """One group with half of the rows, one of null keys, null times, single rows."""
    rows = [(0 if i % 2 else None if i % 14 == 0 else i, None if i % 17 == 0 else (i * 7919) % 3001, f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, t int, id string").repartition(7)
    got = numbers(number_rows(df, ["t", "id"], ["g"], unique=unique), lambda r: r["g"])
    want = defaultdict(list)
    for g, t, i in rows:
        want[g].append((t is not None, t or 0, i))
    assert {g: [(r["t"], r["id"]) for r in rs] for g, rs in got.items()} == {g: [(t if seen else None, i) for seen, t, i in sorted(ts)] for g, ts in want.items()}
    whole = numbers(number_rows(df, ["t", "id"], unique=unique), lambda r: 0)[0]
    assert [(r["t"] is not None, r["t"] or 0, r["id"]) for r in whole] == sorted((t is not None, t or 0, i) for _, t, i in rows)


def test_numbers_of_equal_times(spark, monkeypatch, request):
    """Half of the rows in one group and all times equal: rows are dealt over the ranges and keep one order."""
    stored = []
    keep = numbering.written
    # small ranges are not joined again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    monkeypatch.setattr(numbering, "written", lambda d, n: stored.append(keep(d, n)) or stored[-1])
    df = spark.createDataFrame([("hot" if i % 2 else f"g{i % 40}", START, i) for i in range(8000)], "g string, ts timestamp, id int")
    one = number_rows(df.repartition(5), ["ts"], ["g"])
    two = number_rows(df.repartition(3, "id"), ["ts"], ["g"])
    sizes = {r["_range"]: r["count"] for r in stored[0].groupBy("_range").count().collect()}
    assert len(sizes) > 1 and max(sizes.values()) < 4000
    hot = [r["count"] for r in stored[0].where("_r0 = 'hot'").groupBy("_range").count().collect()]
    assert len(hot) > 1
    assert len(numbers(one, lambda r: r["g"])["hot"]) == 4000
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_range" in plan


def test_numbers_of_copies(spark, monkeypatch):
    """Equal rows are combined before they are dealt and told apart again in blocks."""
    monkeypatch.setattr(numbering, "COPIES", 8)
    df = spark.createDataFrame([("a", 1.0, None)] * 50 + [("a", 0.5, "x")] * 3 + [("b", float("nan"), "y"), ("b", None, "y")], "_c string, _id double, number_ string").repartition(4)
    got = numbers(number_rows(df, ["_id"], ["_c"]), lambda r: r["_c"])
    assert [r["_id"] for r in got["a"]] == [0.5] * 3 + [1.0] * 50
    assert got["b"][0]["_id"] is None and math.isnan(got["b"][1]["_id"])
    assert number_rows(df, ["_id"]).columns == ["_c", "_id", "number_", "number"]
    assert number_rows(df.where("false"), ["_id"], ["_c"]).count() == 0 and number_rows(df.where("false"), ["_id"]).count() == 0
    with pytest.raises(ValueError):
        number_rows(df, ["missing"])


def test_flush_windows_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 4 else "cold", i) for i in range(4000)], "g string, t int").repartition(6)
    got = live.flush_windows(df, ["t"], 300, ["g"]).collect()
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: r["t"]):
        order[r["g"]].append(r["flush_window"])
    assert order == {"hot": [i // 300 for i in range(3000)], "cold": [i // 300 for i in range(1000)]}


def test_overflowing_batch_keeps_its_last_rows(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(107)], "t int, v double").repartition(5)
    monitor = StreamingContinuousDataDriftFlush(df, "v", "Sturges", flush_rate=25)
    monitor.update_stream_batch(df, order="t")
    assert monitor.total_samples == 7
    other = StreamingContinuousDataDriftFlush(df, "v", "Sturges", flush_rate=10**6)
    other.update_stream_batch(df.where("t >= 100"))
    assert monitor.bins == other.bins
    monitor.update_stream_batch(df, order=F.col("t") * -1)
    assert monitor.total_samples == (7 + 107 - 1) % 25 + 1


# ---- dictionaries ----------------------------------------------------------------------------------------------


def test_dictionary_monitor(spark, tmp_path):
    base = spark.createDataFrame([(x,) for x in "aaaabbbccd"], "v string")
    batches = [spark.createDataFrame([(x,) for x in xs], "v string") for xs in ("abz", "aay", "c")]
    folder = f"file://{tmp_path}/one"
    monitor = DictionaryMonitor(spark, folder, "v", compact_every=2)
    with pytest.raises(BaselineError):
        monitor.push_batch(batches[0], 0)
    monitor.reset_baseline(base, 1)
    with pytest.raises(EmptyDatasetError):
        monitor.drift()
    for k in (0, 0, 1, 1, 0):
        monitor.push_batch(batches[k], k)
    # made anew, as after a restart
    monitor = DictionaryMonitor(spark, folder, "v", compact_every=2)
    monitor.push_batch(batches[2], 2)
    monitor.push_batch(batches[2], 2)
    assert monitor.total_samples() == 7
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = {r["metric"]: r["value"] for r in CategoricalBaseline.fit(base, "v").score(every, "v").collect()}
    assert {r["metric"]: r["value"] for r in monitor.drift().collect()} == pytest.approx(want)
    assert {r["label"]: (r["p"], r["n"]) for r in monitor.snapshot().collect()} == {"a": (0.4, 3), "b": (0.3, 1), "c": (0.2, 1), "d": (0.1, 0), None: (0.0, 2)}
    monitor.reset_baseline(every, 2)
    assert monitor.version == 2 and monitor.total_samples() == 0 and monitor.drift().count() == 0
    monitor.push_batch(base, 3)
    assert monitor.total_samples() == 10
    with pytest.raises(BaselineError):
        monitor.reset_baseline(base.where("false"), 3)


def test_dictionary_of_a_million_labels(spark, tmp_path, monkeypatch):
    """No job brings labels to the driver: what is collected has one row."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen = []
    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    labels = spark.range(1_000_000).select(F.col("id").alias("v"))
    monitor = DictionaryMonitor(spark, f"file://{tmp_path}/many", "v")
    monitor.reset_baseline(labels, 1)
    monitor.push_batch(spark.range(500_000, 1_500_000).select(F.col("id").alias("v")), 0)
    got = {r["metric"]: r["value"] for r in monitor.drift().collect()}
    assert got["WassersteinDistance"] == pytest.approx(0.5)
    assert max(len(rows) for rows in seen) <= 4
    held = monitor.weights().agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("other")).first()
    assert tuple(held) == (500_001, 1_000_000, 500_000)


def test_linear_family_by_panes(spark):
    """Metrics of a window equal the metrics of its rows."""
    df = spark.createDataFrame([(at(i), float(i % 5), float(i % 7)) for i in range(90)], "ts timestamp, t double, p double")
    got = panes.sliding_linear(df, "ts", "30 minutes", "10 minutes", "t", "p")
    mine = {r["metric"]: r["value"] for r in got.where(F.col("window.start") == F.lit(at(20))).collect()}
    want = {r["metric"]: r["value"] for r in analysis.linear_report(df.where((F.col("ts") >= F.lit(at(20))) & (F.col("ts") < F.lit(at(50)))), "t", "p").collect()}
    assert mine == pytest.approx(want, nan_ok=True)
