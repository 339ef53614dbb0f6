"""Exact order statistics of many groups in two scans: a rank sketch brackets them, one counting pass settles them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.streaming.shared import shared_folder

#: Size of a rank sketch, how many of its 99 % errors a bracket reaches to either side, and shares at which its values are read.
SKETCH, ERRORS, GRID = 4096, 2.0, 256
#: Groups whose rows of at most some KB each are broadcast; of more, those with this share of all rows are salted.
BROADCAST_GROUPS, HOT_SHARE, SALTS = 5_000, 1 / 2_000, 64


def rank_margin(k: int = SKETCH) -> float:
    """The share of the rows by which a bracket reaches beyond its rank: a KLL sketch is off by 2.296 / k^0.9723 in one case of 100."""
    return ERRORS * 2.296 / k**0.9723


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which cuts the plan and outlives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def group_values(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(_g struct of the group columns, v double): rows whose value is not null."""
    return df.select(_group(by), F.col(column).cast("double").alias("v")).where("v is not null")


def _group(by: Sequence[str]) -> Column:
    return (F.struct(*[F.col(b).alias(f"g{i}") for i, b in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))).alias("_g")


def ungroup(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Puts the group columns back in front."""
    rest = [c for c in df.columns if c != "_g"]
    return df.select(*[F.col("_g")[f"g{i}"].alias(b) for i, b in enumerate(by)], *rest)


def with_group(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Rows (_g, v) with their group's columns; groups has one row a group, with n, the group's rows in its own table.

    Few groups are broadcast. Of many, those with at least HOT_SHARE of the rows, 2000 at most, are known by a small
    broadcast; their rows are dealt over SALTS places, so that a group with half of all rows meets in no one task.
    """
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "_g")
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= F.lit(total * HOT_SHARE)
    hot = groups.where(is_hot).select("_g", F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), "_g", "left").withColumn("_salt", F.when(F.col("_hot"), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn("_salt", F.explode(salts)), ["_g", "_salt"]).drop("_salt")


def summaries(values: DataFrame, places: Mapping[str, Callable[[Column], Column]], k: int = SKETCH) -> DataFrame:
    """(_g, n, lo, hi, sd, nan, spans): a row a group, by one scan; spans holds a place's rank and a bracket of its value.

    The table is written before use: sketches draw at random, so a second computation could give other brackets.
    """
    v, x = F.col("v"), F.when(~F.isnan("v"), F.col("v"))
    found = [F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"), F.count_if(F.isnan(v)).alias("nan")]
    if places:
        found.append(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))
    out = values.groupBy("_g").agg(*found)
    if not places:
        return written(out.withColumn("spans", F.lit(None).cast("array<struct<rank:bigint,low:double,high:double>>")), "quantiles")
    n, margin, last = F.col("n"), F.lit(rank_margin(k)), F.lit(GRID)
    # a sketch gives values at fixed shares only, so brackets end on a grid of shares
    grid = F.kll_sketch_get_quantile_double(F.col("sketch"), F.expr(f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"))
    out = out.select("_g", "n", "lo", "hi", "sd", "nan", F.when(n > 0, grid).alias("grid"))
    spans = []
    for place in places.values():
        rank = place(n).cast("bigint")
        share = (rank + F.lit(0.5)) / n
        below, above = F.floor((share - margin) * GRID).cast("int"), F.ceil((share + margin) * GRID).cast("int")
        low = F.when(below > 0, F.element_at("grid", F.least(below, last) + 1)).otherwise(F.col("lo"))
        high = F.when(above < GRID, F.element_at("grid", F.greatest(above, F.lit(0)) + 1)).otherwise(F.col("hi"))
        spans.append(F.struct(rank.alias("rank"), low.alias("low"), high.alias("high")))
    return written(out.select("_g", "n", "lo", "hi", "sd", "nan", F.when(n > 0, F.array(*spans)).alias("spans")), "quantiles")


def order_statistics(df: DataFrame, column: str, places: Mapping[str, Callable[[Column], Column]], by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """(by..., n, lo, hi, sd, nan, a column a place): exact values at places (from 0) of each group's sorted values.

    places: name -> a function of the column n (the group's rows) that gives the place. Nulls are left out; NaN are
    counted in ``nan`` and left out of everything else; a group of null keys is a group; a group without values has no
    row, one with NaN alone has n = 0 and null values; a place outside 0 .. n - 1 gives null; ties need no rule.

    Two scans, whatever the values: the first sketches ranks, the second counts rows below each bracket and rows by value
    in it, combined before the shuffle. Counts are added up over ranges of (group, place, value) and then within the one
    range that holds a place, so no task holds a group. A bracket that misses its place, which two 99 % errors make rare,
    is found by these counts, and its group is counted again over all its values.
    """
    values = group_values(df, column, by)
    groups = summaries(values, places, k)
    if not places:
        return ungroup(groups.drop("spans"), by)
    n_groups = groups.count()
    out = _settled(values, groups, n_groups, list(places))
    n_missed = out.where("missed").count()
    if n_missed:
        whole = F.transform("spans", lambda s: F.struct(s["rank"].alias("rank"), F.col("lo").alias("low"), F.col("hi").alias("high")))
        again = groups.join(out.where("missed").select("_g"), "_g", "left_semi").withColumn("spans", whole)
        out = out.where("not missed").unionByName(_settled(values, again, n_missed, list(places)))
    return ungroup(out.drop("missed"), by)


def _settled(values: DataFrame, groups: DataFrame, n_groups: int, names: Sequence[str]) -> DataFrame:
    """(_g, n, lo, hi, sd, nan, a column a place, missed) by one scan of the values; missed: a place lies outside its bracket."""
    rows = with_group(values.where(~F.isnan("v")), groups.select("_g", "n", "spans"), n_groups)
    v = F.col("v")
    cell = lambda s, i: F.when(v <= s["high"], F.struct(i.alias("place"), F.when(v >= s["low"], v).alias("v")))
    cells = rows.select("_g", F.explode(F.filter(F.transform("spans", cell), lambda c: c.isNotNull())).alias("cell"))
    counted = cells.groupBy("_g", F.col("cell.place").alias("place"), F.col("cell.v").alias("v")).agg(F.count("*").alias("c"))
    # rows below a bracket have no value and come first
    order = ["_g", "place", F.col("v").asc_nulls_first()]
    ranges = written(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "quantiles")
    before = F.sum("c").over(Window.partitionBy("_g", "place").orderBy("part")) - F.col("c")
    parts = ranges.groupBy("_g", "place", "part").agg(F.sum("c").alias("c")).select("_g", "place", "part", "c", before.alias("before"))
    ranks = groups.select("_g", F.posexplode("spans").alias("place", "span")).select("_g", "place", F.col("span.rank").alias("rank"))
    held = parts.join(ranks, ["_g", "place"]).where("before <= rank and rank < before + c").select("_g", "place", "part", (F.col("rank") - F.col("before")).alias("left"))
    upto = F.sum("c").over(Window.partitionBy("_g", "place", "part").orderBy(F.col("v").asc_nulls_first()))
    inside = ranges.join(held, ["_g", "place", "part"]).select("_g", "place", "v", "c", "left", upto.alias("upto"))
    found = inside.where("upto - c <= left and left < upto and v is not null")
    picked = found.groupBy("_g").agg(F.count("*").alias("found"), *[F.max(F.when(F.col("place") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])
    # a place that the group does not have is none to be found
    wanted = F.coalesce(F.size(F.filter("spans", lambda s: s["rank"].between(0, F.col("n") - 1))), F.lit(0))
    out = groups.join(picked, "_g", "left").withColumn("missed", (F.col("n") > 0) & (F.coalesce("found", F.lit(0)) < wanted))
    return written(out.select("_g", "n", "lo", "hi", "sd", "nan", *names, "missed"), "quantiles")
