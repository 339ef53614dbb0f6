import bisect
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError, DriftInputError, EmptyDatasetError, InvalidMetricError
from gaugeline.operators import drift
from gaugeline.operators.quantiles import order_statistics
from gaugeline.sources.tables import drift_values, from_columns
from gaugeline.streaming.monitors import histogram_divergences

METRICS = ["PopulationStabilityIndex", "KullbackLeibler", "JensenShannon", "WassersteinDistance"]


def numbers(spark, values):
    return from_columns(spark, v=[float(x) for x in values])


@pytest.mark.parametrize(("base", "rule", "bins", "run", "want"), [
    (range(1, 6), "FreedmanDiaconis", 3, range(20, 25), (5.248945, 5.347689, 0.108032, 0.2)),
    (range(100), "FreedmanDiaconis", 5, range(20, 80), (0.211153, 0.104003, 0.037729, 0.113333)),
    (range(100), "Scott", 5, range(20, 80), (0.211153, 0.104003, 0.037729, 0.113333)),
    (range(100), "Sturges", 7, range(20, 80), (10.612964, 11.739876, 0.236453, 0.12)),
])
def test_continuous(spark, base, rule, bins, run, want):
    model = drift.ContinuousDataDrift(numbers(spark, base), "v", rule)
    assert model.num_bins == bins
    assert model.compute_drift_multiple_criteria(numbers(spark, run), METRICS) == pytest.approx(want, abs=1e-6)
    assert model.compute_drift(numbers(spark, base), "PopulationStabilityIndex") == pytest.approx(0, abs=1e-9)
    assert sum(model.export_baseline()) == pytest.approx(1)


@pytest.mark.parametrize(("base", "run", "want"), [
    ("abacba", "cccccc", (23.806206, 23.507580, 0.654858, 0.833333)),
    ("aaaab", "bbbba", (1.663553, 0.831777, 0.278072, 0.6)),
    ("abab", "abcd", (13.815511, 0.693147, 0.311278, 0.5)),
    ("aabbc", "abbcc", (0.277259, 0.138629, 0.049022, 0.2)),
])
def test_categorical(spark, base, run, want):
    model = drift.CategoricalDataDrift(from_columns(spark, v=list(base)), "v")
    assert model.compute_drift_multiple_criteria(from_columns(spark, v=list(run)), METRICS) == pytest.approx(want, abs=1e-6)
    assert model.num_bins == len(set(base)) + 1
    assert sum(model.export_baseline().values()) == pytest.approx(1)


def test_bin_counts():
    for n, k in ((8, 4), (2, 3)):
        assert drift.bin_count("Sturges", n, 0, 1, 0) == k
    values = np.arange(50.0)
    assert drift.bin_count("Scott", 50, 0, 49, float(values.std(ddof=1))) == 4
    assert drift.bin_count("FreedmanDiaconis", 10, 1, 1, 0) == 3


def test_errors(spark):
    with pytest.raises(BaselineError):
        drift.ContinuousBaseline.fit(numbers(spark, [1]), "v")
    with pytest.raises(BaselineError):
        drift.ContinuousBaseline.fit(numbers(spark, [1, float("nan"), 2]), "v")
    with pytest.raises(BaselineError):
        drift.ContinuousBaseline.fit(numbers(spark, [5] * 9), "v", "Sturges")
    assert drift.ContinuousBaseline.fit(numbers(spark, [5] * 9), "v").n_bins == 3
    with pytest.raises(BaselineError):
        drift.CategoricalBaseline.fit(from_columns(spark, v=["a"]).limit(0), "v")
    model = drift.ContinuousDataDrift(numbers(spark, range(9)), "v")
    with pytest.raises(EmptyDatasetError):
        model.compute_drift(numbers(spark, [1]).limit(0), METRICS[0])
    with pytest.raises(InvalidMetricError):
        model.compute_drift(numbers(spark, [1]), "Other")
    with pytest.raises(DriftInputError):
        drift_values(from_columns(spark, v=["1", "x"]), "v")
    with pytest.raises(DriftInputError):
        drift.ContinuousBaseline.fit(spark.createDataFrame([(True,)], "v boolean"), "v")


def test_functions_keep_metric_order(spark):
    a, b = numbers(spark, range(100)), numbers(spark, range(20, 80))
    assert drift.compute_drift_continuous_distribution(a, b, "v", METRICS[::-1]) == drift.compute_drift_continuous_distribution(a, b, "v", METRICS)[::-1]
    c = from_columns(spark, v=list("aabbc"))
    assert drift.compute_drift_categorical_distribution(c, c, "v", ["WassersteinDistance"]) == pytest.approx([0])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=60), st.integers(3, 40), st.lists(st.floats(-2e6, 2e6), max_size=40))
def test_bins_agree_with_a_scan(spark, base, k, probes):
    lo, hi = min(base), max(base)
    if lo == hi:
        return
    edges = drift.bin_edges(lo, hi, k)
    xs = probes + edges + [float("nan"), lo, hi]
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = [r.b for r in df.select(drift.bin_column(F.col("v"), edges, k).alias("b")).collect()]
    for x, b in zip(xs, got, strict=True):
        want = 0 if math.isnan(x) or x < edges[0] else k - 1 if x > edges[-1] else bisect.bisect_right(edges, x)
        assert b == want == drift.bin_of(x, edges, k)


def places(ranks):
    return {f"r{k}": lambda n, k=k: F.lit(k) for k in ranks}


@pytest.mark.parametrize("n", [1, 2, 5, 80, 1000])
def test_order_statistics(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(0, 10, n), 1) if n > 2 else rng.normal(0, 1, n)
    ranks = sorted({0, n // 4, n // 2, (3 * n) // 4 if n > 1 else 0, n - 1})
    got = order_statistics(numbers(spark, values), "v", places(ranks), k=8).first()
    assert [got[f"r{k}"] for k in ranks] == [np.sort(values)[k] for k in ranks]


def test_order_statistics_of_extremes(spark):
    values = [0.0, 1e-300, 1e300, -1e300, 5e-324, 1.0]
    got = order_statistics(numbers(spark, values * 3), "v", places([0, 9, 17]), k=8).first()
    assert [got[f"r{k}"] for k in (0, 9, 17)] == [sorted(values * 3)[k] for k in (0, 9, 17)]


def test_column_and_driver_formulas_agree(spark):
    base = drift.ContinuousBaseline.fit(numbers(spark, range(100)), "v", "Sturges")
    run = numbers(spark, range(20, 80))
    counts = {r["bin"]: r["c"] for r in base.counts(run, "v").collect()}
    c = np.array([counts.get(i, 0) for i in range(base.n_bins)], dtype=float)
    got = {r["metric"]: r["value"] for r in base.score(run, "v").collect()}
    assert histogram_divergences(np.array(base.shares), c, c.sum(), True) == pytest.approx(got, abs=1e-12)


def test_grouped_scores(spark):
    events = spark.createDataFrame([(g, float(x + 10 * g)) for g in range(2) for x in range(50)], "g int, v double")
    base = drift.ContinuousBaseline.fit(events.where("g = 0"), "v")
    got = {(r["g"], r["metric"]): r["value"] for r in base.score(events, "v", by=["g"]).collect()}
    for g in range(2):
        alone = {r["metric"]: r["value"] for r in base.score(events.where(F.col("g") == g), "v").collect()}
        assert {m: got[g, m] for m in alone} == pytest.approx(alone)


def test_one_outlier_makes_very_many_bins(spark):
    import time

    began = time.time()
    rng = np.random.default_rng(1)
    values = [*np.round(rng.normal(0, 3e-5, 1000), 9), 300.0]
    base = drift.ContinuousBaseline.fit(numbers(spark, values), "v")
    assert base.n_bins > 10**6 and not isinstance(base.held, tuple)
    got = {r["metric"]: r["value"] for r in base.score(numbers(spark, values), "v").collect()}
    assert time.time() - began < 60
    assert all(abs(x) < 1e-3 for x in got.values())
    moved = {r["metric"]: r["value"] for r in base.score(numbers(spark, [v + 1 for v in values]), "v").collect()}
    assert moved["PopulationStabilityIndex"] > 10
    # every bin is where adding up the edges puts it
    edges = base.edges.to_array()
    assert len(edges) == base.n_bins - 2 and base.edges[-1] == edges[-1] and base.edges[5_000_001] == edges[5_000_001]
    probes = [*values, *edges[rng.integers(0, len(edges), 60)].tolist(), *np.nextafter(edges[rng.integers(0, len(edges), 60)], -1e9).tolist()]
    found = [r.b for r in numbers(spark, probes).select(drift.bin_column(F.col("v"), base.edges, base.n_bins).alias("b")).collect()]
    assert found == [0 if x < edges[0] else base.n_bins - 1 if x > edges[-1] else int(np.searchsorted(edges, x, side="right")) for x in probes]


def test_bins_in_part_agree_with_all_bins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    old, new = numbers(spark, np.round(rng.normal(0, 1, 3000), 2)), numbers(spark, np.round(rng.normal(0.3, 1.4, 500), 2))
    dense = drift.ContinuousBaseline.fit(old, "v")
    monkeypatch.setattr(drift, "DRIVER_BINS", 3)
    sparse = drift.ContinuousBaseline.fit(old, "v")
    assert isinstance(dense.held, tuple) and not isinstance(sparse.held, tuple) and sparse.shares == dense.shares
    want = {r["metric"]: r["value"] for r in dense.score(new, "v").collect()}
    assert {r["metric"]: r["value"] for r in sparse.score(new, "v").collect()} == pytest.approx(want, abs=1e-11)
    assert sorted(map(tuple, sparse.histogram(new, "v").collect())) == sorted(map(tuple, dense.histogram(new, "v").collect()))
    labels = spark.createDataFrame(list(zip("aaabbcd", [1, 1, 2, 2, None, None, 1])), "v string, g int")
    fitted = drift.CategoricalBaseline.fit(from_columns(spark, v=list("aabxyz")), "v")
    whole = drift._long(drift._scored(fitted.histogram(labels, "v"), None, (), drift.EPS), None, ())
    assert {r["metric"]: r["value"] for r in fitted.score(labels, "v").collect()} == pytest.approx({r["metric"]: r["value"] for r in whole.collect()}, abs=1e-11)
    grouped = {(r["g"], r["metric"]): r["value"] for r in fitted.score(labels, "v", by=["g"]).collect()}
    for g in (1, 2, None):
        alone = {r["metric"]: r["value"] for r in fitted.score(labels.where(F.col("g").eqNullSafe(F.lit(g))), "v").collect()}
        assert {m: grouped[g, m] for m in alone} == pytest.approx(alone, abs=1e-11)


def test_infinite_baselines_are_refused(spark):
    for rule in drift.QuantileType:
        with pytest.raises(BaselineError, match="infinite"):
            drift.ContinuousBaseline.fit(numbers(spark, [1.0, 2.0, float("inf")]), "v", rule)
