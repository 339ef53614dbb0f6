"""Sufficient statistics: aggregate columns of each family, all of one pass and mergeable by sum or max."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import ieee

FACET_CELLS = ("n_a", "pos_a", "n_d", "pos_d")
CONFUSION_CELLS = ("tp", "fp", "tn", "fn")
MODEL_CELLS = tuple(f"{f}_{c}" for f in ("a", "d") for c in CONFUSION_CELLS)
REGRESSION_CELLS = ("n", "sum_e2", "sum_abs", "max_abs", "sum_log2", "sum_ape", "sum_t", "sum_t2", "sum_p2", "sum_tp")
EPS = 1e-12


def facet_cells(facet: Column, label: Column) -> list[Column]:
    """Rows and positives of the favoured (a) and the other facet (d)."""
    return [
        F.count_if(facet).alias("n_a"),
        F.count_if(facet & label).alias("pos_a"),
        F.count_if(~facet).alias("n_d"),
        F.count_if(~facet & label).alias("pos_d"),
    ]


def confusion_cells(truth: Column, pred: Column, where: Column | None = None, prefix: str = "") -> list[Column]:
    ok = F.lit(True) if where is None else where
    tests = {"tp": truth & pred, "fp": ~truth & pred, "tn": ~truth & ~pred, "fn": truth & ~pred}
    return [F.count_if(ok & t).alias(prefix + c) for c, t in tests.items()]


def model_cells(facet: Column, truth: Column, pred: Column) -> list[Column]:
    """The confusion matrix of either facet."""
    return confusion_cells(truth, pred, facet, "a_") + confusion_cells(truth, pred, ~facet, "d_")


def log_penalty(truth: Column, prob: Column, eps: float = EPS) -> Column:
    """Sum of t ln p + (1 - t) ln(1 - p), p held inside [eps, 1 - eps]."""
    t = truth.cast("double")
    p = F.least(F.greatest(prob.cast("double"), F.lit(eps)), F.lit(1 - eps))
    return F.coalesce(F.sum(t * ieee.ln(p) + (F.lit(1.0) - t) * ieee.ln(F.lit(1.0) - p)), F.lit(0.0)).alias("penalty")


def regression_cells(truth: Column, pred: Column) -> list[Column]:
    t, p = truth.cast("double"), pred.cast("double")
    e = F.abs(p - t)
    zero = F.lit(0.0)
    total = lambda x: F.coalesce(F.sum(x), zero)
    return [
        F.count("*").alias("n"),
        total(e * e).alias("sum_e2"),
        total(e).alias("sum_abs"),
        # NaN does not count towards the maximum
        F.coalesce(F.max(F.when(~F.isnan(e), e)), zero).alias("max_abs"),
        total(F.pow(ieee.ln(t + 1) - ieee.ln(p + 1), 2)).alias("sum_log2"),
        total(F.abs(ieee.div(e, t))).alias("sum_ape"),
        total(t).alias("sum_t"),
        total(t * t).alias("sum_t2"),
        total(p * p).alias("sum_p2"),
        total(t * p).alias("sum_tp"),
    ]


def facet_cells_of(facet: bool, label: bool) -> dict[str, int]:
    """One row's cells, as facet_cells counts them."""
    side = "a" if facet else "d"
    return dict.fromkeys(FACET_CELLS, 0) | {f"n_{side}": 1, f"pos_{side}": int(label)}


def confusion_cells_of(truth: bool, pred: bool) -> dict[str, int]:
    hit = {(True, True): "tp", (False, True): "fp", (False, False): "tn", (True, False): "fn"}[truth, pred]
    return dict.fromkeys(CONFUSION_CELLS, 0) | {hit: 1}


def model_cells_of(facet: bool, truth: bool, pred: bool) -> dict[str, int]:
    side = "a" if facet else "d"
    return dict.fromkeys(MODEL_CELLS, 0) | {f"{side}_{c}": n for c, n in confusion_cells_of(truth, pred).items()}


def log_penalty_of(truth: float, prob: float, eps: float = EPS) -> float:
    """One row's term of log_penalty; a NaN probability counts as the largest."""
    p = 1 - eps if math.isnan(prob) else min(max(prob, eps), 1 - eps)
    return truth * math.log(p) + (1 - truth) * math.log(1 - p)


def regression_cells_of(truth: float, pred: float) -> dict[str, float]:
    """One row's cells, as regression_cells sums them."""
    with np.errstate(all="ignore"):
        t, p = np.float64(truth), np.float64(pred)
        e = np.abs(p - t)
        log_gap = np.log(t + 1) - np.log(p + 1)
        row = (1, e * e, e, 0.0 if np.isnan(e) else e, log_gap * log_gap, np.abs(e / t), t, t * t, p * p, t * p)
    return {c: x if c == "n" else float(x) for c, x in zip(REGRESSION_CELLS, row, strict=True)}


def merge(a: dict, b: dict) -> dict:
    """Cells of two disjoint sets of rows together."""
    return {k: max(a[k], b[k]) if k.startswith("max_") else a[k] + b[k] for k in a}
