"""Data drift: fit a baseline histogram, bin the other data, and compare.

Continuous baselines have ``n_bins - 2`` edges from the minimum on: values below the first edge fall into bin 0, values
above the last into the last bin, all others into the bin that counts the edges not above them. Categorical baselines
have a bin for each label and one for all labels that the baseline does not know.

The number of bins follows the data and may be large (an outlier far from closely packed values). Beyond LITERAL_EDGES
edges are not listed: every so many of them is kept, and bins in between come from arithmetic. Beyond DRIVER_BINS only the
bins that hold rows are kept, as a table, and the others enter the metrics in closed form.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from enum import StrEnum

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.errors import BaselineError, DriftInputError, EmptyDatasetError
from gaugeline.functions.ieee import ln
from gaugeline.functions.metrics import drift_names
from gaugeline.operators.quantiles import order_statistics, written

EPS = 1e-12
#: Edges that a plan lists as values; of more, about MARKS are listed. Bins whose shares are kept on the driver.
LITERAL_EDGES, MARKS, DRIVER_BINS = 4096, 256, 100_000


class QuantileType(StrEnum):
    """Rules for the number of bins."""

    FreedmanDiaconis = "FreedmanDiaconis"
    Scott = "Scott"
    Sturges = "Sturges"


def _values(df: DataFrame, column: str) -> DataFrame:
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.StringType)):
        raise DriftInputError(f"{column} is {kind.simpleString()}, a number is needed")
    return df.select(F.col(column).cast("double").alias("v")).where("v is not null")


def bin_count(rule: QuantileType | str, n: int, low: float, high: float, spread: float) -> int:
    """Bins by rule, 3 at least. spread: the interquartile range (Freedman-Diaconis) or the sample deviation (Scott)."""
    rule = QuantileType(rule)
    if rule is QuantileType.Sturges:
        return max(3, math.floor(math.log2(n)) + 1)
    if spread == 0 or high == low:
        return 3
    width = (2.0 if rule is QuantileType.FreedmanDiaconis else 3.49) * spread * n ** (-1.0 / 3.0)
    return max(3, math.ceil((high - low) / width))


class Edges(Sequence):
    """Edges ``low``, ``low + step``, ``(low + step) + step``, ...: every ``every``-th is kept, the others are added up again."""

    def __init__(self, low: float, step: float, count: int):
        self.step, self.count = step, count
        self.every = max(1024, -(-count // MARKS))
        self.marks: list[float] = []
        edge = low
        for i in range(0, count, self.every):
            self.marks.append(float(edge))
            run = np.full(min(self.every, count - i) + (i + self.every < count), step)
            run[0] = edge
            run = np.add.accumulate(run)
            edge, last = run[-1], run[min(self.every, count - i) - 1]
        self.last = float(last)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> float:
        if i < 0:
            i += self.count
        if not 0 <= i < self.count:
            raise IndexError(i)
        run = np.full(i % self.every + 1, self.step)
        run[0] = self.marks[i // self.every]
        return float(np.add.accumulate(run)[-1])

    def to_array(self) -> np.ndarray:
        return np.concatenate([np.add.accumulate(np.concatenate([[m], np.full(min(self.every, self.count - i * self.every) - 1, self.step)])) for i, m in enumerate(self.marks)])


def bin_edges(low: float, high: float, n_bins: int) -> Sequence[float]:
    """Edges by repeated addition, so that they agree to the last bit whoever adds; one edge for constant data."""
    if low == high:
        return [low]
    step = (high - low) / (n_bins - 2)
    if n_bins - 2 > LITERAL_EDGES:
        out = Edges(low, step, n_bins - 2)
        if step < 4 * out.every * math.ulp(max(abs(low), abs(high))):
            raise BaselineError("bins would be narrower than the precision of their edges")
        return out
    edges = [low]
    while len(edges) < n_bins - 2:
        edges.append(edges[-1] + step)
    return edges


def bin_of(x: float, edges: Sequence[float], n_bins: int) -> int:
    """The bin of one value; NaN falls into bin 0."""
    if math.isnan(x) or x < edges[0]:
        return 0
    return n_bins - 1 if x > edges[-1] else bisect.bisect_right(edges, x)


def _upto(value: Column, marks: Sequence[float], step: float) -> Column:
    """How many of the evenly spaced marks (more than 8) are not above the value: a guess, settled among five neighbours."""
    k = len(marks)
    held = F.array(*[F.lit(float(e)) for e in marks])
    guess = F.least(F.greatest(F.floor((value - F.lit(marks[0])) / F.lit(step)).cast("int"), F.lit(2)), F.lit(k - 3))
    return guess - 2 + F.size(F.filter(F.slice(held, guess - 1, F.lit(5)), lambda e: e <= value))


def bin_column(value: Column, edges: Sequence[float], n_bins: int) -> Column:
    """``bin_of`` as a column: the edge is guessed from the step and settled among its neighbours, whatever their number."""
    low, high, k = edges[0], edges[-1], len(edges)
    if isinstance(edges, Edges):
        every, step = edges.every, edges.step
        # few marks are compared one by one, many are guessed
        upto = _upto(value, edges.marks, step * every) if len(edges.marks) > 8 else sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges.marks), F.lit(0))
        mark = F.greatest(upto - 1, F.lit(0))
        base = F.element_at(F.array(*[F.lit(float(e)) for e in edges.marks]), mark + 1)
        steps = F.least(F.greatest(F.floor((value - base) / F.lit(step)), F.lit(0).cast("bigint")), F.lit(every - 1).cast("bigint")).cast("int")
        off = value - (base + steps * F.lit(step))
        # where rounding could decide, the edges around are added up
        slack = F.lit(every * math.ulp(max(abs(low), abs(high))))
        first = F.greatest(steps - 1, F.lit(0))
        edge = F.aggregate(F.sequence(F.lit(0), first), base - F.lit(step), lambda a, i: F.when(i == 0, base).otherwise(a + F.lit(step)))
        near = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(edge.alias("e"), F.lit(0).alias("n")), lambda a, _: F.struct((a["e"] + F.lit(step)).alias("e"), (a["n"] + F.when(a["e"] <= value, 1).otherwise(0)).alias("n")))["n"]
        inner = mark * every + F.when((off > slack) & (F.lit(step) - off > slack), steps + 1).otherwise(first + near)
    elif k <= 8:
        inner = sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    else:
        inner = _upto(value, edges, (high - low) / (k - 1))
    return F.when(F.isnan(value) | (value < F.lit(low)), F.lit(0)).when(value > F.lit(high), F.lit(n_bins - 1)).otherwise(inner).cast("int")


def divergences(interior: Column | None = None, eps: float = EPS) -> dict[str, Column]:
    """Aggregates over bins with columns p (baseline share), c (count) and n (all rows).

    interior: the bins that count for the continuous Wasserstein distance; without it the categorical one is taken.
    """
    p, c, n = F.col("p"), F.col("c").cast("double"), F.col("n").cast("double")
    e = F.lit(eps)
    base, seen = p + e, (c + e) / n
    share = c / n + e
    mid = (base + share) / 2
    gap = F.abs(p + e - share)
    raised = F.greatest(seen, e)
    psi_base = F.greatest(base, e)
    if interior is None:
        distance = F.sum(gap) / 2
    else:
        distance = F.coalesce(F.sum(F.when(interior, gap)), F.lit(0.0)) / F.greatest(F.count_if(interior), F.lit(1))
    return {
        "PopulationStabilityIndex": F.sum((psi_base - raised) * ln(psi_base / raised)),
        "KullbackLeibler": F.sum(base * ln(F.greatest(base / seen, e))),
        "JensenShannon": F.sum((base * ln(base / mid) + share * ln(share / mid)) / 2) / F.lit(math.log(2)),
        "WassersteinDistance": distance,
    }


def _with_total(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds n, the group's rows: an aggregate, joined back (one row where there are no groups)."""
    totals = bins.groupBy(*by).agg(F.sum("c").alias("n"))
    if not by:
        return bins.join(F.broadcast(totals))
    names = [f"_group_{i}" for i in range(len(by))]
    same = F.lit(True)
    for b, name in zip(by, names, strict=True):
        totals = totals.withColumnRenamed(b, name)
        same = same & F.col(b).eqNullSafe(F.col(name))
    return bins.join(totals, same).drop(*names)


def _scored(bins: DataFrame, interior: Column | None, by: Sequence[str], eps: float) -> DataFrame:
    """(by..., the four metrics) from rows (by..., p, c): one row for every bin."""
    rows = _with_total(bins, by).where("n > 0")
    scored = rows.groupBy(*by).agg(F.count("*").alias("_rows"), *[m.alias(k) for k, m in divergences(interior, eps).items()])
    return scored.where("_rows > 0").drop("_rows")


def _scored_in_part(bins: DataFrame, base: DataFrame, n_bins: int, interior: Column | None, by: Sequence[str], eps: float) -> DataFrame:
    """The same from the bins that have rows (by..., p, c; p is 0 where the baseline has none) and the baseline's (p > 0).

    What the baseline's other bins and those empty on both sides add depends on p and the group's rows alone: the sums
    over the whole baseline are taken once, and each group takes off what its own bins would have added.
    """
    e = F.lit(eps)
    b = F.col("p") + e
    mid = (b + e) / 2
    absent = {
        "psi": (b - e) * ln(b / e),
        "kl": b * ln(b),
        "weight": b,
        "js": (b * ln(b / mid) + e * ln(e / mid)) / 2 / F.lit(math.log(2)),
        "gap": F.col("p") if interior is None else F.when(interior, F.col("p")).otherwise(F.lit(0.0)),
    }
    known = F.col("p") > 0
    whole = base.where(known).agg(F.count("*").alias("all_bins"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"all_{k}") for k, x in absent.items()])
    n = F.col("n").cast("double")
    own = divergences(interior, eps)
    gap, share = F.abs(b - (F.col("c").cast("double") / n + e)), F.lit(2.0) if interior is None else F.lit(float(max(n_bins - 2, 1)))
    rows = _with_total(bins, by).where("n > 0")
    seen = rows.groupBy(*by).agg(
        F.first("n").cast("double").alias("n"), F.count("*").alias("bins"), F.count_if(known).alias("own_bins"),
        *[F.coalesce(F.sum(F.when(known, x)), F.lit(0.0)).alias(f"own_{k}") for k, x in absent.items()],
        *[own[m].alias(m) for m in ("PopulationStabilityIndex", "KullbackLeibler", "JensenShannon")],
        F.coalesce(F.sum(gap if interior is None else F.when(interior, gap)), F.lit(0.0)).alias("distance"),
    ).where("bins > 0")
    rest = {k: F.col(f"all_{k}") - F.col(f"own_{k}") for k in absent}
    empty = F.lit(float(n_bins)) - F.col("bins") - (F.col("all_bins") - F.col("own_bins"))
    return seen.join(F.broadcast(whole)).select(
        *by,
        (F.col("PopulationStabilityIndex") + rest["psi"]).alias("PopulationStabilityIndex"),
        (F.col("KullbackLeibler") + rest["kl"] + rest["weight"] * (F.log("n") - F.lit(math.log(eps))) + empty * e * F.log("n")).alias("KullbackLeibler"),
        (F.col("JensenShannon") + rest["js"]).alias("JensenShannon"),
        ((F.col("distance") + rest["gap"]) / share).alias("WassersteinDistance"),
    )


def _long(scored: DataFrame, metrics: Iterable[str] | None, by: Sequence[str]) -> DataFrame:
    names = tuple(dict.fromkeys(drift_names(metrics)))
    pairs = ", ".join(f"'{m}', `{m}`" for m in names)
    return scored.select(*by, F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))


@dataclass(frozen=True)
class ContinuousBaseline:
    """A fitted histogram: edges, and the baseline's share of each bin: listed, or where bins are many a table (bin, p)."""

    edges: Sequence[float]
    held: tuple[float, ...] | DataFrame
    rule: QuantileType
    n_bins: int

    @property
    def shares(self) -> tuple[float, ...]:
        """The share of every bin; where bins are many this lists them all."""
        if isinstance(self.held, tuple):
            return self.held
        got = {r["bin"]: r["p"] for r in self.held.collect()}
        return tuple(got.get(i, 0.0) for i in range(self.n_bins))

    @classmethod
    def fit(cls, df: DataFrame, column: str, rule: QuantileType | str = QuantileType.FreedmanDiaconis) -> ContinuousBaseline:
        """Fits on at least two finite values; nulls are left out. The rows are never sorted as a whole."""
        rule = QuantileType(rule)
        values = _values(df, column)
        places = {"q1": lambda n: F.floor(n * 0.25), "q3": lambda n: F.least(F.floor(n * 0.75), n - 1)} if rule is QuantileType.FreedmanDiaconis else {}
        s = order_statistics(values, "v", places).first()
        if s is None:
            raise BaselineError("a baseline needs two values")
        if s["nan"]:
            raise BaselineError("the baseline holds NaN")
        if s["n"] and (math.isinf(s["lo"]) or math.isinf(s["hi"])):
            raise BaselineError("the baseline holds infinite values")
        if s["n"] < 2:
            raise BaselineError("a baseline needs two values")
        spread = 0.0
        if rule is QuantileType.FreedmanDiaconis:
            spread = s["q3"] - s["q1"]
        elif rule is QuantileType.Scott:
            spread = s["sd"]
        k = bin_count(rule, s["n"], s["lo"], s["hi"], spread)
        if s["lo"] == s["hi"] and k > 3:
            raise BaselineError("this rule has no bins for constant data")
        edges = bin_edges(s["lo"], s["hi"], k)
        counted = values.groupBy(bin_column(F.col("v"), edges, k).alias("bin")).agg(F.count("*").alias("c"))
        if k > DRIVER_BINS:
            # written, so that scores neither read the baseline again nor depend on executors that held it
            return cls(edges, written(counted.select("bin", (F.col("c") / F.lit(float(s["n"]))).alias("p")), "baseline"), rule, k)
        counts = {r["bin"]: r["c"] for r in counted.collect()}
        return cls(tuple(edges) if isinstance(edges, list) else edges, tuple(counts.get(i, 0) / s["n"] for i in range(k)), rule, k)

    def counts(self, df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
        """(by..., bin, c): counts of the bins that have rows."""
        rows = df.select(*by, F.col(column).cast("double").alias("v")).where("v is not null")
        return rows.groupBy(*by, bin_column(F.col("v"), self.edges, self.n_bins).alias("bin")).agg(F.count("*").alias("c"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(bin, p) of every bin."""
        if isinstance(self.held, tuple):
            return spark.createDataFrame([(i, float(p)) for i, p in enumerate(self.held)], "bin int, p double")
        every = spark.range(self.n_bins).select(F.col("id").cast("int").alias("bin"))
        return every.join(self.held, "bin", "left").select("bin", F.coalesce("p", F.lit(0.0)).alias("p"))

    def histogram(self, df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
        """(by..., bin, p, c) with a row for every bin of every group."""
        counted = self.counts(df, column, by)
        base = self.table(df.sparkSession)
        if by:
            bins = F.explode(F.sequence(F.lit(0), F.lit(self.n_bins - 1)))
            base = counted.select(*by).distinct().select(*by, bins.alias("bin")).join(base, "bin")
            keys = [*by, "bin"]
            right = counted.toDF(*[f"_{i}" for i in range(len(keys))], "c")
            same = F.lit(True)
            for i, name in enumerate(keys):
                same = same & F.col(name).eqNullSafe(F.col(f"_{i}"))
            return base.join(right, same, "left").select(*by, "bin", "p", F.coalesce("c", F.lit(0)).alias("c"))
        return base.join(counted, "bin", "left").select("bin", "p", F.coalesce("c", F.lit(0)).alias("c"))

    def interior(self) -> Column:
        return F.col("bin").between(1, self.n_bins - 2)

    def score(self, df: DataFrame, column: str, metrics: Iterable[str] | None = None, by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
        """(by..., metric, value) of the data against the baseline; no rows where there is no data."""
        if isinstance(self.held, tuple) and not by:
            return _long(_scored(self.histogram(df, column), self.interior(), by, eps), metrics, by)
        return self.score_weights(self.counts(df, column, by), by, eps, metrics)

    def score_weights(self, weights: DataFrame, by: Sequence[str] = (), eps: float = EPS, metrics: Iterable[str] | None = None) -> DataFrame:
        """The same from the weights of the bins that have some: rows (by..., bin, c), one for a bin of a group."""
        base = self.table(weights.sparkSession) if isinstance(self.held, tuple) else self.held
        rows = weights.join(base, "bin", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        return _long(_scored_in_part(rows, base, self.n_bins, self.interior(), by, eps), metrics, by)


class CategoricalBaseline:
    """Label shares (label, p) as a table; it stays in Spark however many labels there are."""

    def __init__(self, labels: DataFrame, n_labels: int):
        self.labels, self.n_labels = labels, n_labels

    @property
    def n_bins(self) -> int:
        return self.n_labels + 1

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> CategoricalBaseline:
        """Nulls are left out; any type is taken as its text."""
        counted = df.select(F.col(column).cast("string").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("c"))
        # written, so that neither shares nor scores read the baseline again or depend on executors that held it
        counted = written(counted, "baseline")
        s = counted.agg(F.sum("c").alias("n"), F.count("*").alias("k")).first()
        if not s["n"]:
            raise BaselineError("the baseline is empty")
        return cls(counted.select("label", (F.col("c") / F.lit(float(s["n"]))).alias("p")), s["k"])

    def _counts(self, df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
        return df.select(*by, F.col(column).cast("string").alias("label")).where("label is not null").groupBy(*by, "label").agg(F.count("*").alias("c"))

    def histogram(self, df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
        """(by..., label, p, c): every baseline label, and one row for all others (label null).

        With groups this is a table of groups x labels; scores do without it.
        """
        counted = self._counts(df, column, by)
        base = self.labels
        if by:
            base = counted.select(*by).distinct().join(base)
        both = base.join(counted, [*by, "label"], "full_outer")
        known = F.col("p").isNotNull()
        rows = both.groupBy(*by, F.when(known, F.col("label")).alias("label")).agg(F.coalesce(F.first("p"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
        groups = counted.select(*by).distinct() if by else df.sparkSession.range(1).select()
        empty = groups.withColumns({"label": F.lit(None).cast("string"), "p": F.lit(0.0), "c": F.lit(0).cast("long")})
        return rows.unionByName(empty).groupBy(*by, "label").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))

    def score(self, df: DataFrame, column: str, metrics: Iterable[str] | None = None, by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
        """(by..., metric, value) of the data against the baseline; no rows where there is no data."""
        return self.score_weights(self._counts(df, column, by), by, eps, metrics)

    def score_weights(self, weights: DataFrame, by: Sequence[str] = (), eps: float = EPS, metrics: Iterable[str] | None = None) -> DataFrame:
        """The same from labels' weights: rows (by..., label, c); a null label stands for labels that the baseline does not know."""
        seen = weights.join(self.labels, "label", "left")
        # labels that the baseline does not know share a bin
        rows = seen.groupBy(*by, F.when(F.col("p").isNotNull(), F.col("label")).alias("label")).agg(F.coalesce(F.first("p"), F.lit(0.0)).alias("p"), F.sum("c").alias("c"))
        return _long(_scored_in_part(rows, self.labels, self.n_bins, None, by, eps), metrics, by)


def _listed(scored: DataFrame, metrics: Sequence[str]) -> list[float]:
    got = {r["metric"]: r["value"] for r in scored.collect()}
    if not got:
        raise EmptyDatasetError("no data to compare with the baseline")
    return [got[str(getattr(m, "value", m))] for m in metrics]


def compute_drift_continuous_distribution(baseline: DataFrame, candidate: DataFrame, column: str, metrics: Sequence[str], quantile_type: QuantileType | str | None = None, eps: float = EPS) -> list[float]:
    """The metrics, in their order."""
    drift_names(metrics)
    return _listed(ContinuousBaseline.fit(baseline, column, quantile_type or QuantileType.FreedmanDiaconis).score(candidate, column, metrics, eps=eps), metrics)


def compute_drift_categorical_distribution(baseline: DataFrame, candidate: DataFrame, column: str, metrics: Sequence[str], eps: float = EPS) -> list[float]:
    drift_names(metrics)
    return _listed(CategoricalBaseline.fit(baseline, column).score(candidate, column, metrics, eps=eps), metrics)


class _DriftModel:
    """Shared surface of the two drift models: one baseline, any number of stateless comparisons."""

    baseline: ContinuousBaseline | CategoricalBaseline
    column: str
    eps: float

    def compute_drift(self, df: DataFrame, metric: str) -> float:
        return self.compute_drift_multiple_criteria(df, [metric])[0]

    def compute_drift_multiple_criteria(self, df: DataFrame, metrics: Sequence[str]) -> list[float]:
        drift_names(metrics)
        return _listed(self.baseline.score(df, self.column, metrics, eps=self.eps), metrics)

    @property
    def num_bins(self) -> int:
        return self.baseline.n_bins


class ContinuousDataDrift(_DriftModel):
    def __init__(self, df: DataFrame, column: str, quantile_type: QuantileType | str = QuantileType.FreedmanDiaconis, eps: float = EPS):
        self.column, self.rule, self.eps = column, QuantileType(quantile_type), eps
        self.reset_baseline(df)

    def reset_baseline(self, df: DataFrame) -> None:
        """Fits anew by the same rule."""
        self.baseline = ContinuousBaseline.fit(df, self.column, self.rule)

    def export_baseline(self) -> list[float]:
        return list(self.baseline.shares)


class CategoricalDataDrift(_DriftModel):
    def __init__(self, df: DataFrame, column: str, eps: float = EPS):
        self.column, self.eps = column, eps
        self.reset_baseline(df)

    def reset_baseline(self, df: DataFrame) -> None:
        self.baseline = CategoricalBaseline.fit(df, self.column)

    def export_baseline(self) -> dict[str, float]:
        """Share of each label; the bin of unknown labels is not listed."""
        return {r["label"]: r["p"] for r in self.baseline.labels.collect()}
