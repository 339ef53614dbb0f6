"""SQL building blocks of the DuckDB equivalents: the same definitions, written down a second time."""

from __future__ import annotations


def long(metrics: dict[str, str], source: str, by: str = "", value: str = "value") -> str:
    """UNION ALL of (by, metric, value rounded to six places) over a one-row (or one-row-a-group) relation."""
    head = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {head}'{m}' AS metric, round(CAST({x} AS DOUBLE), 6) + 0.0 AS {value} FROM {source}" for m, x in metrics.items())


def facet_cte(rows: str, by: str = "") -> str:
    """rows: SQL giving Boolean columns f and g (and by)."""
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""(SELECT {head}CAST(n_a AS DOUBLE) AS n_a, CAST(n_d AS DOUBLE) AS n_d, pos_a / CAST(n_a AS DOUBLE) AS p, pos_d / CAST(n_d AS DOUBLE) AS q FROM (
  SELECT {head}count(*) FILTER (WHERE f) AS n_a, count(*) FILTER (WHERE f AND g) AS pos_a, count(*) FILTER (WHERE NOT f) AS n_d, count(*) FILTER (WHERE NOT f AND g) AS pos_d
  FROM ({rows}) r WHERE f IS NOT NULL AND g IS NOT NULL{group}) k)"""


def _kl(p: str, q: str) -> str:
    return f"({p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q})))"


DATA_BIAS = {
    "ClassImbalance": "abs(n_a - n_d) / (n_a + n_d)",
    "DifferenceInProportionOfLabels": "p - q",
    "KlDivergence": _kl("p", "q"),
    "JsDivergence": f"0.5 * ({_kl('p', '((p + q) / 2)')} + {_kl('q', '((p + q) / 2)')})",
    "LpNorm": "sqrt(pow(p - q, 2) + pow((1 - p) - (1 - q), 2))",
    "TotalVariationDistance": "0.5 * (abs(p - q) + abs((1 - p) - (1 - q)))",
    "KolmogorovSmirnov": "greatest(abs(p - q), abs((1 - p) - (1 - q)))",
}


def model_cte(rows: str, by: str = "") -> str:
    """rows: SQL giving Boolean columns f, g (truth) and h (prediction)."""
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    cells = ", ".join(
        f"CAST(count(*) FILTER (WHERE {'f' if s == 'a' else 'NOT f'} AND {'g' if c in ('tp', 'fn') else 'NOT g'} AND {'h' if c in ('tp', 'fp') else 'NOT h'}) AS DOUBLE) AS {s}_{c}"
        for s in "ad"
        for c in ("tp", "fp", "tn", "fn")
    )
    derived = ", ".join(f"{s}_tp + {s}_fp + {s}_tn + {s}_fn AS {s}_n, {s}_tp + {s}_fp AS {s}_pp, {s}_tp + {s}_fn AS {s}_pg" for s in "ad")
    return f"(SELECT *, {derived}, a_fn + d_fn AS b0, a_tp + d_tp AS b1, a_fp + d_fp + a_tn + d_tn AS b2 FROM (SELECT {head}{cells} FROM ({rows}) r WHERE f IS NOT NULL AND g IS NOT NULL AND h IS NOT NULL{group}) k)"


_ENTROPY = "((b0 * pow(0 * (b0 + b1 + b2) / (b1 + 2 * b2), 2) + b1 * pow((b0 + b1 + b2) / (b1 + 2 * b2), 2) + b2 * pow(2 * (b0 + b1 + b2) / (b1 + 2 * b2), 2)) - (b0 + b1 + b2))"

MODEL_BIAS = {
    "DifferenceInPositivePredictedLabels": "a_pp / a_n - d_pp / d_n",
    "DisparateImpact": "(a_pp / a_n) / (d_pp / d_n)",
    "AccuracyDifference": "(a_tp + a_tn) / a_n - (d_tp + d_tn) / d_n",
    "RecallDifference": "a_tp / a_pg - d_tp / d_pg",
    "DifferenceInConditionalAcceptance": "a_pp / a_pg - d_pp / d_pg",
    "DifferenceInAcceptanceRate": "a_tp / a_pp - d_tp / d_pp",
    "SpecialityDifference": "a_tn / (a_tn + a_fp) - d_tn / (d_tn + d_fp)",
    "DifferenceInConditionalRejection": "(d_n - d_pg) / (d_n - d_pp) - (a_n - a_pg) / (a_n - a_pp)",
    "DifferenceInRejectionRate": "d_tn / (d_tn + d_fn) - a_tn / (a_tn + a_fn)",
    "TreatmentEquity": "d_fn / d_fp - a_fn / a_fp",
    "ConditionalDemographicDesparityPredictedLabels": """(a_n * ((a_n - a_pp) / ((a_n - a_pp) / (a_n - a_pp + d_n - d_pp)) - a_pp / (a_pp / (a_n - a_pp + d_n - d_pp)))
      + d_n * ((d_n - d_pp) / ((d_n - d_pp) / (a_n - a_pp + d_n - d_pp)) - d_pp / (d_pp / (a_n - a_pp + d_n - d_pp)))) / (a_n + d_n)""",
    "GeneralizedEntropy": _ENTROPY,
}

MODEL_BIAS_ADHOC = MODEL_BIAS | {
    "DifferenceInPositivePredictedLabels": "a_pp / a_pg - d_pp / d_pg",
    "DisparateImpact": "CASE WHEN d_pp = 0 THEN 0 ELSE (a_pp / d_pg) / (d_pp / d_pg) END",
    "DifferenceInConditionalAcceptance": "a_pg / a_pp - d_pg / d_pp",
    "DifferenceInAcceptanceRate": "a_tp / (a_tp + d_fp) - d_tp / d_pp",
    "SpecialityDifference": "d_tn / (d_tn + d_fp) - a_tn / (a_tn + a_fp)",
    "ConditionalDemographicDesparityPredictedLabels": "(d_n - d_pp) / (a_n - a_pp + d_n - d_pp) - d_pp / (a_pp + d_pp)",
    "GeneralizedEntropy": f"{_ENTROPY} * 0.5 * (a_n + d_n)",
}


def confusion_cte(rows: str, extra: str = "", by: str = "") -> str:
    """rows: SQL giving Boolean columns g (truth) and h (prediction)."""
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    cells = ", ".join(f"CAST(count(*) FILTER (WHERE {t}) AS DOUBLE) AS {c}" for c, t in (("tp", "g AND h"), ("fp", "NOT g AND h"), ("tn", "NOT g AND NOT h"), ("fn", "g AND NOT h")))
    return f"(SELECT {head}{cells}{extra} FROM ({rows}) r WHERE g IS NOT NULL AND h IS NOT NULL{group})"


CLASSIFICATION = {
    "BalancedAccuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "PrecisionPositive": "tp / (tp + fp)",
    "PrecisionNegative": "tn / (tn + fn)",
    "RecallPositive": "tp / (tp + fn)",
    "RecallNegative": "tn / (tn + fp)",
    "Accuracy": "(tp + tn) / (tp + fp + tn + fn)",
    "F1Score": "2 * (tp / (tp + fn)) * (tp / (tp + fp)) / (tp / (tp + fn) + tp / (tp + fp))",
}
LOGISTIC = CLASSIFICATION | {"LogLoss": "-penalty / (tp + fp + tn + fn)"}
PENALTY = ", sum(t * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - t) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) AS penalty"


def regression_cte(rows: str, by: str = "") -> str:
    """rows: SQL giving doubles t and p."""
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""(SELECT {head}CAST(count(*) AS DOUBLE) AS n, sum(pow(p - t, 2)) AS e2, sum(abs(p - t)) AS e1, max(abs(p - t)) AS em, sum(pow(ln(1 + t) - ln(1 + p), 2)) AS l2,
  sum(abs(abs(p - t) / t)) AS ape, sum(abs(p - t) / t) AS spe, sum(t) AS st, sum(t * t) AS st2, sum(p * p) AS sp2, sum(t * p) AS stp FROM ({rows}) r WHERE t IS NOT NULL AND p IS NOT NULL{group})"""


LINEAR = {
    "RootMeanSquaredError": "sqrt(e2 / n)",
    "MeanSquaredError": "e2 / n",
    "MeanAbsoluteError": "e1 / n",
    "RSquared": "1 - (st2 - 2 * stp + sp2) / (st2 - st * st / n)",
    "MaxError": "em",
    "MeanSquaredLogError": "l2 / n",
    "RootMeanSquaredLogError": "sqrt(l2 / n)",
    "MeanAbsolutePercentageError": "ape / n",
}
LINEAR_ADHOC = LINEAR | {"MeanAbsolutePercentageError": "spe / n"}


def paired(latest: str, baseline: str, only: str = "") -> str:
    where = f" WHERE metric IN ({only})" if only else ""
    return f"(SELECT l.metric, l.value AS x, b.value AS b FROM ({latest}) l JOIN ({baseline}) b USING (metric){where})"


#: (fails, drift) by family for the threshold t.
CHECKS = {
    "data_bias": (
        "CASE WHEN metric IN ('ClassImbalance', 'DifferenceInProportionOfLabels') THEN abs(x) > abs(b) * (1 + {t}) ELSE x > b * (1 + {t}) END",
        "CASE metric WHEN 'ClassImbalance' THEN abs(abs(x) - abs(b)) WHEN 'DifferenceInProportionOfLabels' THEN abs(x - b) ELSE x - b END",
    ),
    "model_bias": (
        "CASE WHEN metric IN ('DisparateImpact', 'GeneralizedEntropy') THEN x > b * (1 + {t}) ELSE abs(x) > abs(b) * (1 + {t}) END",
        "CASE WHEN metric IN ('DisparateImpact', 'GeneralizedEntropy') THEN abs(x - b) ELSE abs(abs(x) - abs(b)) END",
    ),
    "BinaryClassification": ("x * (1 + {t}) < b", "b - x"),
    "LogisticRegression": ("CASE WHEN metric = 'LogLoss' THEN x > b * (1 + {t}) ELSE x < b * (1 - {t}) END", "CASE WHEN metric = 'LogLoss' THEN x - b ELSE b - x END"),
    "LinearRegression": ("CASE WHEN metric = 'RSquared' THEN x < b * (1 - {t}) ELSE x > b * (1 + {t}) END", "CASE WHEN metric = 'RSquared' THEN b - x ELSE x - b END"),
}
SNAPSHOTS = {
    "data_bias": "abs(x - b) / greatest(abs(b), 1e-12)",
    "model_bias": "abs(x - b) / abs(b)",
    "BinaryClassification": "b - x",
    "LogisticRegression": "b - x",
    "LinearRegression": "abs(b - x)",
}


def check(family: str, latest: str, baseline: str, t: float, only: str = "") -> str:
    fails, drift = (x.format(t=t) for x in CHECKS[family])
    return f"SELECT metric, round({drift}, 6) + 0.0 AS drift FROM {paired(latest, baseline, only)} WHERE {fails}"


def snapshot(family: str, latest: str, baseline: str, only: str = "") -> str:
    return f"SELECT metric, round({SNAPSHOTS[family]}, 6) + 0.0 AS value FROM {paired(latest, baseline, only)}"


def divergence(bins: str, wasserstein: str) -> dict[str, str]:
    """Metrics over (bin, p, c, n)."""
    e = "1e-12"
    base, seen, share = f"(p + {e})", f"((c + {e}) / n)", f"(c / n + {e})"
    mid = f"(({base} + {share}) / 2)"
    return {
        "PopulationStabilityIndex": f"(SELECT sum(({base} - greatest({seen}, {e})) * ln({base} / greatest({seen}, {e}))) FROM {bins})",
        "KullbackLeibler": f"(SELECT sum({base} * ln(greatest({base} / {seen}, {e}))) FROM {bins})",
        "JensenShannon": f"(SELECT sum(0.5 * {base} * ln({base} / {mid}) + 0.5 * {share} * ln({share} / {mid})) / ln(2) FROM {bins})",
        "WassersteinDistance": wasserstein.format(gap=f"abs({base} - {share})", bins=bins),
    }


def continuous(base_rows: str, runtime_rows: str, rule: str) -> str:
    """CTEs ending in ``bins`` (bin, p, c, n): base_rows and runtime_rows give a double v."""
    width = {
        "FreedmanDiaconis": "CASE WHEN q3 = q1 OR hi = lo THEN 3 ELSE ceil((hi - lo) / (2.0 * (q3 - q1) * pow(n, -1.0 / 3.0))) END",
        "Scott": "CASE WHEN hi = lo OR sd = 0 THEN 3 ELSE ceil((hi - lo) / (3.49 * sd * pow(n, -1.0 / 3.0))) END",
        "Sturges": "floor(log2(n)) + 1",
    }[rule]
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM ({base_rows}) x WHERE v IS NOT NULL),
  run AS MATERIALIZED (SELECT v FROM ({runtime_rows}) x WHERE v IS NOT NULL),
  s AS MATERIALIZED (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM base),
  q AS MATERIALIZED (SELECT s.*, (SELECT v FROM base WHERE k = CAST(floor(0.25 * s.n) AS BIGINT)) AS q1, (SELECT v FROM base WHERE k = least(CAST(floor(0.75 * s.n) AS BIGINT), s.n - 1)) AS q3 FROM s),
  f AS MATERIALIZED (SELECT lo, hi, n, greatest(3, CAST({width} AS INTEGER)) AS nb FROM q),
  e AS (SELECT 1 AS i, lo AS edge, (hi - lo) / (nb - 2) AS step, nb FROM f UNION ALL SELECT i + 1, edge + step, step, nb FROM e WHERE i < nb - 2),
  ed AS MATERIALIZED (SELECT list(edge ORDER BY i) AS edges, max(nb) AS nb FROM e),
  bb AS (SELECT CASE WHEN v < edges[1] THEN 0 WHEN v > edges[len(edges)] THEN nb - 1 ELSE len(list_filter(edges, lambda z: z <= v)) END AS bin FROM base, ed),
  rb AS (SELECT CASE WHEN v < edges[1] THEN 0 WHEN v > edges[len(edges)] THEN nb - 1 ELSE len(list_filter(edges, lambda z: z <= v)) END AS bin FROM run, ed),
  bc AS (SELECT bin, count(*) AS c FROM bb GROUP BY bin), rc AS (SELECT bin, count(*) AS c FROM rb GROUP BY bin),
  bins AS MATERIALIZED (SELECT g.bin, coalesce(bc.c, 0) / CAST(f.n AS DOUBLE) AS p, CAST(coalesce(rc.c, 0) AS DOUBLE) AS c, (SELECT CAST(count(*) AS DOUBLE) FROM run) AS n, f.nb AS nb
    FROM (SELECT unnest(range(0, nb)) AS bin FROM f) g CROSS JOIN f LEFT JOIN bc ON bc.bin = g.bin LEFT JOIN rc ON rc.bin = g.bin)"""


INTERIOR = "(SELECT sum(CASE WHEN bin BETWEEN 1 AND nb - 2 THEN {gap} ELSE 0 END) / max(greatest(nb - 2, 1)) FROM {bins})"
HALF = "(SELECT 0.5 * sum({gap}) FROM {bins})"


def categorical(base_rows: str, runtime_rows: str) -> str:
    """CTEs ending in ``bins`` (label, p, c, n): both give a text l."""
    return f"""WITH bc AS MATERIALIZED (SELECT l, count(*) AS c FROM ({base_rows}) x WHERE l IS NOT NULL GROUP BY l),
  rc AS MATERIALIZED (SELECT l, count(*) AS c FROM ({runtime_rows}) x WHERE l IS NOT NULL GROUP BY l),
  t AS (SELECT (SELECT CAST(sum(c) AS DOUBLE) FROM bc) AS nb, (SELECT CAST(sum(c) AS DOUBLE) FROM rc) AS n),
  bins AS MATERIALIZED (SELECT bc.l, bc.c / nb AS p, CAST(coalesce(rc.c, 0) AS DOUBLE) AS c, n FROM bc CROSS JOIN t LEFT JOIN rc USING (l)
    UNION ALL SELECT NULL, 0.0, (SELECT CAST(coalesce(sum(c), 0) AS DOUBLE) FROM rc WHERE l NOT IN (SELECT l FROM bc)), n FROM t)"""
