"""Mixing sources to target weights: iterative proportional fitting, then calibrated Poisson sampling.

Tokens are counted by cell (source, language, topic). Cell weights are raked until the weighted tokens meet the target
shares of every dimension's values. A document is kept with probability min(1, rate * weight of its cell); the rate is
calibrated so that the expected tokens meet the budget, capped cells included.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import topics
from gaugeline.llm._names import fresh
from gaugeline.llm._store import Scratch

#: Exponent of the default targets: a value's share of tokens is raised to it, which lifts small values.
TEMPER = 0.7
#: Share of the tokens to keep.
BUDGET = 0.7
#: Cells that are raked on the driver; more of them stay a table and are raked by joins, in the same steps.
MOST_CELLS = 200_000
#: Sweeps at most, and the largest error of a share at which raking ends. It also ends, and reports the error, with a sweep
#: that lowers the error by less than a part STILL of it: targets that cannot be met together.
SWEEPS, CLOSE, STILL = 500, 1e-9, 1e-6
DIMENSIONS = ("source", "lang", "topic")


def token_count(text: str = "text") -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Weights of cells such that weighted tokens meet the targets, and the largest remaining error of a share.

    codes: each dimension's value number by cell; targets: each dimension's shares. A value with target 0 gets weight 0;
    targets of values without tokens are spread over the others.
    """
    total = tokens.sum()
    weight = np.ones(len(tokens))
    if not total:
        return weight, 0.0
    shares = []
    for code, target in zip(codes, targets, strict=True):
        have = np.bincount(code, weights=tokens, minlength=len(target)) > 0
        share = np.where(have, target, 0.0)
        if share.sum() <= 0:
            raise ValueError("no value with tokens has a positive target")
        shares.append(share / share.sum())
    error = np.inf
    for _ in range(sweeps):
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, weights=tokens * weight, minlength=len(share))
            weight = weight * np.divide(share * total, now, out=np.zeros_like(now), where=now > 0)[code]
        last, error = error, max(float(np.abs(np.bincount(code, weights=tokens * weight, minlength=len(share)) / total - share).max()) for code, share in zip(codes, shares, strict=True))
        if error < close or error > last * (1 - STILL):
            break
    return weight, error


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, rate * weight) whose expected tokens are ``budget``, or all that have a weight if that is less."""
    reach = tokens[weight > 0].sum()
    if budget >= reach:
        return (weight > 0).astype(float)
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order].astype(float), weight[order]
    # with the first i cells capped at 1 the others share what is left in proportion to their weight
    capped = np.concatenate([[0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    rate = np.divide(budget - capped, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    with np.errstate(invalid="ignore"):
        at = np.flatnonzero((rate * w <= 1 + 1e-12) & (rate >= 0))
    return np.clip(rate[at[0]] * weight, 0, 1) if len(at) else (weight > 0).astype(float)


_TABLE = "_source string, _lang string, _topic string, mix_weight double, keep_probability double"


def _report(error: float) -> None:
    """Targets that contradict each other, or that cells cannot meet, are not met silently."""
    if error > CLOSE:
        warnings.warn(f"raking ended with an error of {error:.3g} in a share: the targets cannot be met together", stacklevel=3)


def _mixed_cells(spark: SparkSession, cells: list, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """Weights and probabilities of cells that are at hand."""
    tokens = np.array([r["tokens"] for r in cells], dtype=float)
    codes, shares = [], []
    for c in DIMENSIONS:
        values = sorted({r[f"_{c}"] for r in cells})
        number = {v: i for i, v in enumerate(values)}
        codes.append(np.array([number[r[f"_{c}"]] for r in cells], dtype=int))
        if c in targets:
            shares.append(np.array([float(targets[c].get(v, 0.0)) for v in values]))
        else:
            shares.append(np.bincount(codes[-1], weights=tokens, minlength=len(values)) ** TEMPER if values else np.zeros(0))
    wanted = np.ones(len(cells), dtype=bool)
    for c, code, share in zip(DIMENSIONS, codes, shares, strict=True):
        if c in targets:
            wanted &= share[code] > 0
    weight = keep = wanted.astype(float)
    if tokens.sum():
        weight, error = rake(tokens, codes, shares)
        _report(error)
        # cells without tokens cost nothing: they stay where their values are wanted
        keep = np.where(tokens == 0, wanted, calibrate(tokens, weight, budget * tokens.sum()))
    rows = [(*(r[f"_{c}"] for c in DIMENSIONS), float(w), float(p)) for r, w, p in zip(cells, weight, keep, strict=True)]
    return spark.createDataFrame(rows, _TABLE)


def _mixed_table(spark: SparkSession, counted: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """The same for a table of cells of any size: every step is an aggregate by value and a join back.

    Raked by the same sweeps to the same error; the rate is that of ``calibrate``, found by adding capped cells until
    no more are capped.
    """
    scratch = Scratch(spark, "mixing")
    now = scratch.keep(counted.withColumn("w", F.lit(1.0)), "cells-0")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    shares, wanted = {}, F.lit(True)
    for c in DIMENSIONS:
        have = now.groupBy(f"_{c}").agg(F.sum("tokens").alias("t"))
        if c in targets:
            named = spark.createDataFrame([(str(k), float(v)) for k, v in targets[c].items()], f"`_{c}` string, raw double")
            have = have.join(named, f"_{c}", "left").withColumn("raw", F.when(F.col("t") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(F.lit(0.0)))
            wanted = wanted & F.col(f"_{c}").isin([k for k, v in targets[c].items() if v > 0])
        else:
            have = have.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(TEMPER)))
        shares[c] = scratch.keep(have.select(f"_{c}", "raw"), f"shares-{c}")
        whole = float(shares[c].agg(F.sum("raw")).first()[0] or 0)
        if total and whole <= 0:
            raise ValueError("no value with tokens has a positive target")
        shares[c] = shares[c].select(f"_{c}", (F.col("raw") / F.lit(whole or 1.0) * F.lit(total)).alias("goal"))
    mass = F.sum(F.col("tokens") * F.col("w"))
    error = float("inf") if total else 0.0
    for k in range(1, SWEEPS + 1 if total else 1):
        for c in DIMENSIONS:
            factor = now.groupBy(f"_{c}").agg(mass.alias("m")).join(shares[c], f"_{c}").select(f"_{c}", F.when(F.col("m") > 0, F.col("goal") / F.col("m")).otherwise(F.lit(0.0)).alias("f"))
            now = now.join(factor, f"_{c}").withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = scratch.keep(now, f"cells-{k}")
        scratch.drop(f"cells-{k - 1}")
        off = [now.groupBy(f"_{c}").agg(mass.alias("m")).join(shares[c], f"_{c}").agg(F.max(F.abs(F.col("m") - F.col("goal")))).first()[0] for c in DIMENSIONS]
        last, error = error, max(off) / total
        if error < CLOSE or error > last * (1 - STILL):
            break
    _report(error)
    reach = float(now.agg(F.sum(F.when(F.col("w") > 0, F.col("tokens")))).first()[0] or 0)
    if total and budget * total < reach:
        rate, capped = 0.0, -1
        while True:
            full = F.col("w") * F.lit(rate) >= 1
            r = now.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("w"))), F.lit(0.0))).first()
            if r[0] == capped or r[2] <= 0:
                break
            capped, rate = r[0], (budget * total - r[1]) / r[2]
        keep = F.least(F.lit(1.0), F.col("w") * F.lit(rate))
    else:
        keep = F.when(F.col("w") > 0, 1.0).otherwise(0.0)
    keep = F.when(F.col("tokens") == 0, F.when(wanted, 1.0).otherwise(0.0)).otherwise(keep)
    return now.select("_source", "_lang", "_topic", F.col("w").alias("mix_weight"), keep.alias("keep_probability"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """Adds (topic, mix_weight, keep_probability, sampled) to every row.

    targets: shares by value for ``source``, ``lang`` or ``topic``; a dimension without targets gets its tokens' shares
    raised to TEMPER. A value that given targets do not name gets weight 0. Nulls count as the value "". Targets that
    cannot be met together end in a warning with the remaining error. ``budget`` is the share of all tokens to keep.
    topic: any column; without one, topics are learned from all texts (``topics.learn``) and every whole text is
    given one. ``sampled`` compares a hash of id and seed with the probability, so it does not depend on partitions;
    repeated rows and all rows of one id share it (rows without an id are told apart by their text). Null and empty
    texts cost nothing and stay where their values are wanted. An empty table stays empty. Columns of the added names
    are replaced, all others are kept whatever their names.
    """
    rows = docs.drop("mix_weight", "keep_probability", "sampled")
    if topic is None:
        (words,) = fresh(rows, "tokens")
        rows = topics.assign(rows, topics.learn(rows, text_col), text_col, tokens=words)
        counting = F.col(words)
    else:
        words = None
        rows = rows.withColumn("topic", topic)
        counting = token_count(text_col)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in DIMENSIONS]
    counted = rows.select(*key, counting.alias("tokens")).groupBy(*[f"_{c}" for c in DIMENSIONS]).agg(F.sum("tokens").alias("tokens"))
    cells = counted.limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        table = _mixed_table(spark, counted, targets or {}, budget)
    else:
        table = F.broadcast(_mixed_cells(spark, cells, targets or {}, budget))
    inner = fresh(rows, *(f"cell_{c}" for c in DIMENSIONS))
    for c, name in zip(DIMENSIONS, inner, strict=True):
        table = table.withColumnRenamed(f"_{c}", name)
        rows = rows.withColumn(name, F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined = rows.join(table, list(inner)).drop(*inner, *([words] if words else []))
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    uniform = F.shiftrightunsigned(place, 11).cast("double") / F.lit(float(1 << 53))
    return joined.withColumn("sampled", uniform < F.col("keep_probability"))
