"""Order statistics, baselines and distinct tests of many groups or columns against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError
from gaugeline.functions import segments
from gaugeline.operators import drift, grouped_drift, quantiles
from gaugeline.operators.grouped_drift import GroupedContinuousBaseline
from gaugeline.operators.quantiles import order_statistics

PLACES = {"first": lambda n: F.lit(0), "q1": lambda n: F.floor(n * 0.25), "q3": lambda n: F.least(F.floor(n * 0.75), n - 1), "last": lambda n: n - 1, "beyond": lambda n: n}


def uneven(n=30_000):
    """One group with half of the rows, one with ties only, one of null keys, and many small ones."""
    rng = np.random.default_rng(3)
    group = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 60, n))
    value = np.where(group == 7, 4.0, np.round(rng.lognormal(0, 3, n), 3))
    return [(None if g == 9 else int(g), float(v)) for g, v in zip(group, value, strict=True)]


def expected(rows):
    held = defaultdict(list)
    for g, v in rows:
        held[g].append(v)
    out = {}
    for g, vs in held.items():
        vs.sort()
        n = len(vs)
        out[g] = (n, vs[0], vs[-1], vs[0], vs[n // 4], vs[min(int(0.75 * n), n - 1)], vs[-1], None)
    return out


@pytest.mark.parametrize(("k", "errors", "broadcast"), [(4096, 2.0, 5000), (64, 2.0, 5000), (64, 0.0, 5000), (64, 2.0, 0)])
def test_order_statistics_by_group(spark, monkeypatch, k, errors, broadcast):
    """Large brackets, narrow ones, brackets that miss their places, and groups too many to broadcast."""
    monkeypatch.setattr(quantiles, "ERRORS", errors)
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", broadcast)
    rows = uneven()
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = order_statistics(df, "x", PLACES, ["g"], k).drop("sd", "nan").collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == expected(rows)


def test_order_statistics_of_odd_rows(spark):
    rows = [("a", 1.0, 1), ("a", float("nan"), 2), ("a", None, 3), ("a", 1.0, 4), ("nan", float("nan"), 5), ("null", None, 6), ("zero", -0.0, 7), ("zero", 0.0, 8), ("inf", float("inf"), 9), ("inf", 1.0, 10)]
    df = spark.createDataFrame(rows, "n string, v double, _g int")
    got = {r[0]: r for r in order_statistics(df, "v", {"top": lambda n: n - 1}, ["n"]).toDF("key", "n", "lo", "hi", "sd", "nan", "top").collect()}
    assert set(got) == {"a", "nan", "zero", "inf"}
    assert (got["a"]["n"], got["a"]["nan"], got["a"]["top"]) == (2, 1, 1.0)
    assert (got["nan"]["n"], got["nan"]["nan"], got["nan"]["top"]) == (0, 1, None)
    assert got["zero"]["top"] == 0.0 and got["inf"]["top"] == float("inf")
    assert order_statistics(df.where("false"), "v", {"top": lambda n: n - 1}, ["n"]).count() == 0
    whole = order_statistics(df.where("v < 2"), "v", {"top": lambda n: n - 1})
    assert whole.columns == ["n", "lo", "hi", "sd", "nan", "top"] and [(r["n"], r["top"]) for r in whole.collect()] == [(5, 1.0)]


def test_hot_groups_are_dealt(spark, monkeypatch):
    """Beyond a broadcast, a group with half of the rows is spread over the salts."""
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    rows = quantiles.group_values(spark.range(100_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("g"), F.col("id").alias("x")), "x", ["g"])
    groups = quantiles.summaries(rows, {})
    joined = quantiles.with_group(rows, groups, groups.count())
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 100_000 and max(sizes) < 15_000


@pytest.mark.parametrize("rule", list(drift.QuantileType))
def test_grouped_baselines_equal_single_ones(spark, rule):
    rows = [(g, v) for g, v in uneven(12_000) if g != 7]
    old = spark.createDataFrame(rows[:8000], "g int, x double")
    new = spark.createDataFrame([*rows[8000:], (3, None), (3, float("nan")), (1000, 5.0)], "g int, x double")
    fitted = GroupedContinuousBaseline.fit(old, "x", ["g"], rule)
    assert fitted.refused.count() == 0
    got = defaultdict(dict)
    for r in fitted.score(new, "x").collect():
        got[r["g"]][r["metric"]] = r["value"]
    assert len(got) == len({g for g, _ in rows[:8000]} & {g for g, _ in rows[8000:]})
    for g in (0, None, 3, 20):
        mine = F.col("g").eqNullSafe(F.lit(g))
        single = drift.ContinuousBaseline.fit(old.where(mine), "x", rule)
        want = {r["metric"]: r["value"] for r in single.score(new.where(mine), "x").collect()}
        assert got[g] == pytest.approx(want, abs=1e-9), g


def test_bins_are_where_added_up_edges_put_them(spark, monkeypatch):
    """Values on edges, next to them and beyond, in groups with few and with very many edges."""
    monkeypatch.setattr(grouped_drift, "STEPS", 8)
    monkeypatch.setattr(grouped_drift, "MOST_MARKS", 50)
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(0, 1, 3000), 1: np.arange(64.0), 2: np.append(rng.normal(0, 1e-2, 3000), 900.0), 3: np.array([0.1, 0.2, 0.3] * 5), 4: 1e15 + np.array([0.0, 1.0, 2.0, 3.0] * 4)}
    old = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, x double")
    fitted = GroupedContinuousBaseline.fit(old, "x", ["g"])
    bins = {r["_g"]["g0"]: r["n_bins"] for r in fitted.edges.collect()}
    assert bins[2] > 100_000
    for g, vs in groups.items():
        lo, hi, k = float(min(vs)), float(max(vs)), bins[g] - 2
        edges = np.add.accumulate(np.concatenate([[lo], np.full(k - 1, (hi - lo) / k)]))
        some = edges[rng.integers(0, k, 50)]
        probes = np.concatenate([some, np.nextafter(some, 1e300), np.nextafter(some, -1e300), vs[:100], [lo - 1, hi + 1, edges[-1], lo, hi]])
        got = {r["bin"]: r["c"] for r in fitted.counts(spark.createDataFrame([(g, float(v)) for v in probes], "g int, x double"), "x").collect()}
        want = defaultdict(int)
        for x in probes:
            want[0 if x < edges[0] else bins[g] - 1 if x > edges[-1] else int(np.searchsorted(edges, x, side="right"))] += 1
        assert got == want, g


def test_groups_without_a_baseline_are_listed(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("ok", 1.0), ("ok", 2.0), ("one", 1.0), ("nan", nan), ("nan", 1.0), ("inf", inf), ("inf", 1.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    common = {"one": "two values needed", "nan": "NaN", "inf": "infinite"}
    for rule, more in (("FreedmanDiaconis", {}), ("Sturges", {"flat": "constant"})):
        fitted = GroupedContinuousBaseline.fit(df, "x", ["g"], rule)
        assert {r["g"]: r["reason"] for r in fitted.refused.collect()} == common | more
        scored = {r["g"] for r in fitted.score(df, "x", ["PopulationStabilityIndex"]).collect()}
        assert scored == {"ok", "flat"} - set(more)
    with pytest.raises(BaselineError):
        drift.ContinuousBaseline.fit(df.where("g = 'flat'"), "x", "Sturges")
    empty = GroupedContinuousBaseline.fit(df.where("false"), "x", ["g"])
    assert empty.score(df, "x").count() == empty.refused.count() == 0


@pytest.mark.parametrize(("distinct", "n"), [(3, 40), (4, 40), (3, 2000), (99, 2000), (100, 2000), (101, 2000), (4500, 100_000), (5000, 100_000), (5001, 100_000), (5600, 100_000), (9000, 100_000), (0, 0), (1, 1)])
def test_distinct_tests_at_the_boundary(spark, distinct, n):
    # the columns differ by type and by nulls; -0.0 is no other number than 0.0
    rows = spark.range(n).select((F.col("id") % max(distinct, 1)).alias("whole"), (F.col("id") % max(distinct, 1) * F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)).alias("signed"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("holes"), F.col("id").cast("decimal(20,2)").alias("exact"))
    seen = rows.agg(*[F.struct(F.count_distinct(F.col(c) + F.lit(0)).alias("d"), F.count(c).alias("n")).alias(c) for c in rows.columns]).first()
    want = {c: segments.is_categorical(seen[c]["d"], seen[c]["n"]) for c in rows.columns}
    assert segments.categorical_columns(rows, rows.columns) == want


def test_distinct_tests_shuffle_no_values(spark, monkeypatch):
    """Away from the boundary there is one aggregate without a distinct count, whatever the number of columns."""
    asked = []
    exact = F.count_distinct
    monkeypatch.setattr(segments.F, "count_distinct", lambda *c: asked.append(c) or exact(*c))
    rows = spark.range(50_000).select("id", (F.col("id") % 10).alias("few"), (F.col("id") * 0.5).alias("half"))
    assert segments.categorical_columns(rows, ["id", "few", "half"]) == {"id": False, "few": True, "half": False}
    assert not asked
    assert segments.categorical_columns(rows.select((F.col("id") % 2500).alias("edge")), ["edge"]) == {"edge": True} and len(asked) == 1
    assert math.isclose(quantiles.rank_margin(4096), 0.0014, abs_tol=2e-4)
