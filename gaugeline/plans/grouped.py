"""Registered queries of forms that treat many groups or columns at once: order statistics, baselines, distinct tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.segments import categorical_columns, heuristic_segments
from gaugeline.operators.grouped_drift import GroupedContinuousBaseline
from gaugeline.operators.quantiles import order_statistics
from gaugeline.plans import catalogue as K
from gaugeline.plans import oracle as O
from gaugeline.plans.catalogue import query, table, values

# ---- exact order statistics ------------------------------------------------------------------------------------

_PLACES = {
    "q1": lambda n: F.floor(n * 0.25),
    "median": lambda n: F.floor((n - 1) / 2),
    "q3": lambda n: F.least(F.floor(n * 0.75), n - 1),
    "p99": lambda n: F.floor(n * 0.99),
}


def _ranked(value: str, keys: str, source: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    picks = {"q1": "CAST(floor(0.25 * n) AS BIGINT)", "median": "(n - 1) // 2", "q3": "least(CAST(floor(0.75 * n) AS BIGINT), n - 1)", "p99": "CAST(floor(0.99 * n) AS BIGINT)"}
    chosen = ", ".join(f"max(v) FILTER (WHERE k = {at}) AS {name}" for name, at in picks.items())
    lead = f"{keys}, " if keys else ""
    return f"""WITH r AS (SELECT {lead}{value} AS v, row_number() OVER ({part} ORDER BY {value}) - 1 AS k, count(*) OVER ({part}) AS n FROM {source})
SELECT {lead}max(n) AS n, min(v) AS lo, max(v) AS hi, {chosen} FROM r{f' GROUP BY {keys}' if keys else ''}"""


@query("order_statistics", _ranked("CAST(l_extendedprice AS DOUBLE)", "", "lineitem"))
def all_order_statistics(spark, sf_dir):
    return order_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PLACES).drop("sd", "nan")


@query("order_statistics_by_supplier", _ranked("CAST(l_extendedprice AS DOUBLE)", "l_suppkey", "lineitem"))
def order_statistics_by_supplier(spark, sf_dir):
    return order_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PLACES, ["l_suppkey"]).drop("sd", "nan")


@query("order_statistics_with_ties", _ranked("CAST(l_quantity AS DOUBLE)", "l_returnflag, l_linestatus", "lineitem"))
def order_statistics_with_ties(spark, sf_dir):
    return order_statistics(table(spark, sf_dir, "lineitem"), "l_quantity", _PLACES, ["l_returnflag", "l_linestatus"]).drop("sd", "nan")


# ---- a baseline a group ----------------------------------------------------------------------------------------


def _grouped_sql(key: str, value: str, source: str, old: str, new: str, rule: str) -> str:
    """Each group's runtime rows against its own edges and shares: the rules of the single baseline with a group key everywhere."""
    width = {
        "FreedmanDiaconis": "CASE WHEN q3 = q1 OR hi = lo THEN 3 ELSE ceil((hi - lo) / (2.0 * (q3 - q1) * pow(n, -1.0 / 3.0))) END",
        "Scott": "CASE WHEN hi = lo OR sd = 0 THEN 3 ELSE ceil((hi - lo) / (3.49 * sd * pow(n, -1.0 / 3.0))) END",
        "Sturges": "floor(log2(n)) + 1",
    }[rule]
    bin_ = "CASE WHEN v < edges[1] THEN 0 WHEN v > edges[len(edges)] THEN nb - 1 ELSE len(list_filter(edges, lambda z: z <= v)) END"
    metrics = {m: x.replace("FROM bins", "FROM mine").replace("(SELECT ", "", 1).removesuffix(")").replace(" FROM mine", "") for m, x in O.divergence("bins", O.INTERIOR).items()}
    wide = ", ".join(f"{x} AS {m}" for m, x in metrics.items())
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT {key} AS g, CAST({value} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS k FROM {source} WHERE {old}),
  run AS MATERIALIZED (SELECT {key} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {new}),
  s AS MATERIALIZED (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM base GROUP BY g),
  q AS MATERIALIZED (SELECT s.g, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(sd) AS sd, max(v) FILTER (WHERE k = CAST(floor(0.25 * n) AS BIGINT)) AS q1,
    max(v) FILTER (WHERE k = least(CAST(floor(0.75 * n) AS BIGINT), n - 1)) AS q3 FROM s JOIN base USING (g) WHERE n >= 2 GROUP BY s.g),
  f AS MATERIALIZED (SELECT g, lo, hi, n, greatest(3, CAST({width} AS INTEGER)) AS nb FROM q),
  e AS (SELECT g, 1 AS i, lo AS edge, (hi - lo) / (nb - 2) AS step, nb FROM f UNION ALL SELECT g, i + 1, edge + step, step, nb FROM e WHERE i < nb - 2),
  ed AS MATERIALIZED (SELECT g, list(edge ORDER BY i) AS edges, max(nb) AS nb FROM e GROUP BY g),
  bc AS (SELECT g, {bin_} AS bin, count(*) AS c FROM base JOIN ed USING (g) GROUP BY 1, 2), rc AS (SELECT g, {bin_} AS bin, count(*) AS c FROM run JOIN ed USING (g) GROUP BY 1, 2),
  rn AS (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM run GROUP BY g),
  bins AS MATERIALIZED (SELECT u.g, u.bin, coalesce(bc.c, 0) / CAST(u.n AS DOUBLE) AS p, CAST(coalesce(rc.c, 0) AS DOUBLE) AS c, rn.n, u.nb
    FROM (SELECT g, n, nb, unnest(range(0, nb)) AS bin FROM f) u JOIN rn USING (g) LEFT JOIN bc ON bc.g = u.g AND bc.bin = u.bin LEFT JOIN rc ON rc.g = u.g AND rc.bin = u.bin),
  w AS MATERIALIZED (SELECT g, {wide} FROM bins GROUP BY g)
""" + " UNION ALL ".join(f"SELECT g AS {key}, '{m}' AS metric, round({m}, 6) + 0.0 AS value FROM w" for m in metrics)


_L_OLD, _L_NEW = "l_shipdate < TIMESTAMP '1996-01-01'", "l_shipdate >= TIMESTAMP '1996-01-01'"

for _rule, _name in (("FreedmanDiaconis", "fd"), ("Scott", "scott"), ("Sturges", "sturges")):

    @query(f"drift_own_baseline_{_name}", _grouped_sql("l_suppkey", "l_extendedprice", "lineitem", _L_OLD, _L_NEW, _rule))
    def drift_own_baseline(spark, sf_dir, rule=_rule):
        lines = table(spark, sf_dir, "lineitem")
        fitted = GroupedContinuousBaseline.fit(K._when(lines, _L_OLD), "l_extendedprice", ["l_suppkey"], rule)
        return values(fitted.score(K._when(lines, _L_NEW), "l_extendedprice"))


@query("drift_own_baseline_large_groups", _grouped_sql("l_linenumber", "l_extendedprice", "lineitem", _L_OLD, _L_NEW, "FreedmanDiaconis"))
def drift_own_baseline_large_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    fitted = GroupedContinuousBaseline.fit(K._when(lines, _L_OLD), "l_extendedprice", ["l_linenumber"])
    return values(fitted.score(K._when(lines, _L_NEW), "l_extendedprice"))


# ---- distinct tests of several columns ---------------------------------------------------------------------------

_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_FEW = "(count(DISTINCT {c}) <= 3 OR count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) <= 0.05)"


@query("categorical_columns", " UNION ALL ".join(f"SELECT '{c}' AS col, {_FEW.format(c=c)} AS categorical FROM lineitem" for c in _COLUMNS))
def categorical_of_lineitem(spark, sf_dir):
    found = categorical_columns(table(spark, sf_dir, "lineitem"), _COLUMNS)
    return spark.createDataFrame(sorted(found.items()), "col string, categorical boolean")


_LABELS = (("l_linenumber", 3), ("l_extendedprice", 40000.0), ("l_quantity", 25.0), ("l_orderkey", 1000))


@query("heuristic_labeling_many", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE CASE WHEN (SELECT {_FEW.format(c=c)} FROM lineitem) THEN {c} = {v} ELSE {c} >= {v} END) AS {c}" for c, v in _LABELS) + " FROM lineitem")
def heuristic_labeling_many(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.agg(*[F.count_if(s).alias(c) for (c, _), s in zip(_LABELS, heuristic_segments(lines, _LABELS), strict=True)])
