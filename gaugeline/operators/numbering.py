"""Numbers rows in their full order, by group, where no task holds a group: ranges are numbered, then shifted by those before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.quantiles import written

#: Equal rows that a block of copies holds when they are told apart again.
COPIES = 4096
#: monotonically_increasing_id: the partition is above these bits, the place of a row in it below.
_PLACE_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "number", unique: bool = False) -> DataFrame:
    """Adds ``name``: the place of a row, from 0, among its group's rows in ascending order of ``order``, nulls first.

    Ties stand in order of a hash of the whole row, then of its columns. Rows equal in all columns are combined with a
    count before they are dealt (0.0 and -0.0 then count as one value), so neither they nor rows of one time meet in one
    task; ``unique`` says that by and order tell all rows apart, which saves that shuffle. A group of null keys is a group.

    Rows are cut into ranges of (group, order, hash), numbered within their range, and written once, since cuts are drawn
    from a sample. What lies before a range in its group is a sum over ranges: one row for each pair of group and range.
    Columns of maps cannot be ordered and need ``unique``.
    """
    by, order = list(by), list(order)
    if missing := {*by, *order} - {*df.columns}:
        raise ValueError(f"no such columns: {sorted(missing)}")
    rest = [c for c in df.columns if c not in {*by, *order}]
    packed = df.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(df.columns)])
    at = {c: f"_r{i}" for i, c in enumerate(df.columns)}
    groups, sort = [at[b] for b in by], [at[c] for c in order]
    if unique:
        rows, keys, last = packed.withColumn("_c", F.lit(1).cast("long")), [*groups, *sort], []
    else:
        rows = packed.groupBy(*at.values()).agg(F.count("*").alias("_c")).withColumn("_tie", F.xxhash64(*at.values()))
        keys, last = [*groups, *sort, "_tie"], [at[c] for c in rest]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *last).withColumn("_id", F.monotonically_increasing_id())
    stored = written(ranged.withColumn("_range", F.shiftright("_id", _PLACE_BITS)), "numbers")
    sizes = stored.groupBy(*groups, "_range").agg(F.sum("_c").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("_n")).drop("_n")
    # at most one group a range began in an earlier range, so this is no longer than the list of ranges
    carried = F.broadcast(before.where("_before > 0").select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], F.col("_range").alias("_k"), "_before"))
    same = F.col("_range") == F.col("_k")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    if unique and not groups:
        inside = stored.withColumn("_inside", F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1))
    else:
        inside = stored.withColumn("_inside", F.sum("_c").over(Window.partitionBy(*groups, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c"))
    placed = inside.join(carried, same, "left").withColumn("_number", F.col("_inside") + F.coalesce("_before", F.lit(0)))
    if not unique:
        until = F.col("_number") + F.col("_c") - 1
        blocks = placed.withColumn("_from", F.explode(F.sequence("_number", until, F.lit(COPIES).cast("long")))).withColumn("_until", F.least(F.col("_from") + COPIES - 1, until))
        placed = blocks.withColumn("_number", F.explode(F.sequence("_from", "_until")))
    return placed.select(*[F.col(x).alias(c) for c, x in at.items()], F.col("_number").alias(name))
