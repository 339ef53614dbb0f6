"""Drift of numbers with a baseline a group: every group has its own edges, fitted for all groups in three scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.drift import EPS, QuantileType, _long, divergences
from gaugeline.operators.quantiles import group_values, order_statistics, ungroup, with_group, written

#: Edges from one mark to the next, where a group has no more than MOST_MARKS times as many.
STEPS, MOST_MARKS = 64, 4096


def _fitted_edges(low: pd.Series, step: pd.Series, count: pd.Series) -> pd.DataFrame:
    """Every ``every``-th of the edges low, low + step, (low + step) + step, ... and the last one."""
    out = []
    for first, width, n in zip(low, step, count, strict=True):
        every, marks, edge = max(STEPS, -(-int(n) // MOST_MARKS)), [], first
        for i in range(0, int(n), every):
            run = np.full(min(every, int(n) - i) + 1, width)
            run[0] = edge
            run = np.add.accumulate(run)
            marks.append(float(edge))
            last, edge = run[-2], run[-1]
        out.append((every, marks, float(last)))
    return pd.DataFrame(out, columns=["every", "marks", "last"])


def _n_bins(rule: QuantileType) -> Column:
    """Bins of a group by rule, 3 at least."""
    n, extent = F.col("n").cast("double"), F.col("hi") - F.col("lo")
    if rule is QuantileType.Sturges:
        return F.greatest(F.lit(3), F.floor(F.log2(n)) + 1).cast("bigint")
    width = (2.0 if rule is QuantileType.FreedmanDiaconis else 3.49) * F.col("spread") * F.pow(n, F.lit(-1.0 / 3.0))
    bins = F.when((F.col("spread") == 0) | (extent == 0), F.lit(3.0)).otherwise(F.try_divide(extent, width))
    return F.greatest(F.lit(3), F.ceil(F.least(bins, F.lit(9e15)))).cast("bigint")


def _bin() -> Column:
    """The bin of v in its group's edges: a mark and an edge are guessed from the step; edges are added up where rounding could decide."""
    v, step, marks, every, k = F.col("v"), F.col("step"), F.col("marks"), F.col("every"), F.col("n_bins") - 2
    guess = F.greatest(F.least(F.floor(F.try_divide(v - F.col("lo"), step * every)).cast("int"), F.size(marks) - 1), F.lit(0))
    mark = F.greatest(guess - F.when(F.element_at(marks, guess + 1) > v, 1).otherwise(0) + F.when((guess + 1 < F.size(marks)) & (F.try_element_at(marks, guess + 2) <= v), 1).otherwise(0), F.lit(0))
    base = F.element_at(marks, mark + 1)
    most = F.least(every - 1, k - 1 - mark * every)
    s = F.greatest(F.least(F.floor(F.try_divide(v - base, step)), most), F.lit(0).cast("bigint"))
    off = v - (base + s * step)
    # where bins are narrow against the numbers' precision the guess is no guide, and all edges up to the next mark are added up
    upto = F.when(step < 4 * F.col("slack"), most).otherwise(F.least(s + 1, most)).cast("bigint")
    count = F.aggregate(F.sequence(F.lit(0).cast("bigint"), upto), F.struct(base.alias("e"), F.lit(0).cast("bigint").alias("n")),
                        lambda a, _: F.struct((a["e"] + step).alias("e"), (a["n"] + F.when(a["e"] <= v, 1).otherwise(0)).alias("n")))["n"]
    inner = mark * every + F.when((off > F.col("slack")) & (step - off > F.col("slack")), s + 1).otherwise(count)
    return F.when(F.isnan(v) | (v < F.col("lo")), F.lit(0)).when(v > F.col("last"), F.col("n_bins") - 1).when(step == 0, F.lit(1)).otherwise(inner).cast("bigint").alias("bin")


@dataclass(frozen=True)
class GroupedContinuousBaseline:
    """Tables of fitted groups: edges (_g, n, lo, step, n_bins, marks, ...), shares (_g, bin, p) of occupied bins, refused (by..., reason)."""

    edges: DataFrame
    shares: DataFrame
    refused: DataFrame
    by: tuple[str, ...]
    n_groups: int

    @classmethod
    def fit(cls, df: DataFrame, column: str, by: Sequence[str], rule: QuantileType | str = QuantileType.FreedmanDiaconis) -> GroupedContinuousBaseline:
        """Fits each group of ``by`` as a single baseline would be fitted; null keys form a group.

        A group without a proper baseline is listed in ``refused`` and takes no part in scores, where a single baseline
        raises an error: 'NaN', 'infinite', 'two values needed', 'constant' (Sturges), 'precision' (more
        bins than one mark's, and narrower than their edges are exact). A group whose values are all null has no row. Extra columns are not read.
        """
        rule = QuantileType(rule)
        places = {"q1": lambda n: F.floor(n * 0.25), "q3": lambda n: F.least(F.floor(n * 0.75), n - 1)} if rule is QuantileType.FreedmanDiaconis else {}
        stats = order_statistics(df, column, places, by).select(F.struct(*[F.col(b).alias(f"g{i}") for i, b in enumerate(by)]).alias("_g"), "n", "lo", "hi", "sd", "nan", *places)
        spread = F.col("q3") - F.col("q1") if places else F.col("sd") if rule is QuantileType.Scott else F.lit(0.0)
        infinite = (F.abs("lo") == F.lit(float("inf"))) | (F.abs("hi") == F.lit(float("inf")))
        stats = stats.withColumn("spread", spread)
        sound = (F.col("nan") == 0) & (F.col("n") >= 2) & ~infinite
        stats = stats.withColumn("n_bins", F.when(sound, _n_bins(rule)))
        step = F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise((F.col("hi") - F.col("lo")) / (F.col("n_bins") - 2))
        stats = stats.withColumn("step", step)
        # each sum is off by a unit in the last place at most; 2^-52 of a number is at least its unit
        unit = F.greatest(F.abs("lo"), F.abs("hi")) * F.lit(2.0**-52)
        every = F.greatest(F.lit(STEPS), F.ceil((F.col("n_bins") - 2) / MOST_MARKS))
        stats = stats.withColumn("slack", every * unit)
        reason = (
            F.when(F.col("nan") > 0, "NaN").when(infinite, "infinite").when(F.col("n") < 2, "two values needed")
            .when((F.col("step") == 0) & (F.col("lo") == F.col("hi")) & (F.col("n_bins") > 3), "constant")
            .when((F.col("n_bins") - 2 > every) & (F.col("step") * every < 4 * (F.col("n_bins") - 2) * unit), "precision")
        )
        stats = written(stats.withColumn("reason", reason), "baselines")
        refused = ungroup(stats.where("reason is not null").select("_g", "reason"), by)
        fitted = F.pandas_udf(_fitted_edges, "every int, marks array<double>, last double")
        good = stats.where("reason is null").withColumn("count", F.when(F.col("step") == 0, F.lit(1)).otherwise(F.col("n_bins") - 2))
        edges = written(good.withColumn("e", fitted("lo", "step", "count")).select("_g", "n", "lo", "step", "n_bins", "slack", "e.*"), "baselines")
        n_groups = edges.count()
        counted = with_group(group_values(df, column, by), edges, n_groups).select("_g", _bin(), "n").groupBy("_g", "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        shares = written(counted.select("_g", "bin", (F.col("c") / F.col("n").cast("double")).alias("p")), "baselines")
        return cls(edges, shares, refused, tuple(by), n_groups)

    def counts(self, df: DataFrame, column: str) -> DataFrame:
        """(_g, bin, c): counts of the bins that have rows, of the groups with a baseline; nulls are left out, NaN fall into bin 0."""
        return with_group(group_values(df, column, self.by), self.edges, self.n_groups).select("_g", _bin()).groupBy("_g", "bin").agg(F.count("*").alias("c"))

    def score(self, df: DataFrame, column: str, metrics: Iterable[str] | None = None, eps: float = EPS) -> DataFrame:
        """(by..., metric, value) of each group against its own baseline; groups without rows or without a baseline have none.

        Bins that are empty on both sides are not listed: they add n_empty * eps * ln(n) to one divergence and nothing to the others.
        """
        counts = self.counts(df, column)
        totals = counts.groupBy("_g").agg(F.sum("c").alias("n")).join(self.edges.select("_g", "n_bins"), "_g")
        bins = self.shares.join(counts, ["_g", "bin"], "full").select("_g", "bin", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c")).join(totals, "_g")
        interior = F.col("bin").between(1, F.col("n_bins") - 2)
        gap = F.abs(F.col("p") + F.lit(eps) - (F.col("c") / F.col("n").cast("double") + F.lit(eps)))
        own = divergences(interior, eps)
        known = [own[m].alias(m) for m in ("PopulationStabilityIndex", "KullbackLeibler", "JensenShannon")]
        seen = bins.groupBy("_g").agg(F.first("n").alias("n"), F.first("n_bins").alias("n_bins"), F.count("*").alias("bins"), *known, F.coalesce(F.sum(F.when(interior, gap)), F.lit(0.0)).alias("distance"))
        empty = (F.col("n_bins") - F.col("bins")) * F.lit(eps) * F.log(F.col("n").cast("double"))
        scored = seen.select("_g", "PopulationStabilityIndex", (F.col("KullbackLeibler") + empty).alias("KullbackLeibler"), "JensenShannon", (F.col("distance") / F.greatest(F.col("n_bins") - 2, F.lit(1))).alias("WassersteinDistance"))
        return _long(ungroup(scored, self.by), metrics, self.by)
