"""Joins of rows with a table of their keys, some of which may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least HOT_ROWS rows and one in HOT_KEYS of all rows is hot; so there are HOT_KEYS hot keys at most.
HOT_ROWS, HOT_KEYS = 100, 2000


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, spread_by: Column, all_rows: bool = False) -> DataFrame:
    """rows joined with ``table``, which has one row for each key and its number of rows as ``members``.

    Hot keys' rows of ``table`` are broadcast (HOT_KEYS at most), and the rows of hot keys are dealt by key and ``spread_by``
    together, so no task holds a hot key. total: the number of rows, or a bound from below.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    values = [c for c in table.columns if c not in (*keys, "members")]
    packed = F.struct(*[F.col(c) for c in values], F.lit(1).alias("_one"))
    hot = table.where(F.col("members") >= least).select(*keys, packed.alias("_hot"))
    # zero, but not a literal: the optimiser would take a constant out of the join's keys, and hot rows would meet by key
    zero = F.least(F.col("members").cast("long"), F.lit(0).cast("long"))
    cold = table.where(F.col("members") < least).select(*keys, zero.alias("_salt"), packed.alias("_cold"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread_by).bitwiseOR(F.lit(1))))
    both = dealt.join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    if not all_rows:
        both = both.where(F.col("_got").isNotNull())
    return both.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in values])


#: Buckets by which ids with very many pairs are found.
BUCKETS = 4096


def _bucket(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")


def hot_ends(pairs: DataFrame) -> list[int] | None:
    """For each bucket of ids, over how many copies to deal its pairs (a, b) of a written table; None where all have one.

    A bucket is hot with HOT_ROWS pair ends and four times its share. BUCKETS numbers reach the driver.
    """
    counts: dict[int, int] = {}
    for end in ("a", "b"):
        for r in pairs.groupBy(_bucket(end).alias("bucket")).agg(F.count("*").alias("n")).collect():
            counts[r["bucket"]] = counts.get(r["bucket"], 0) + r["n"]
    least = max(HOT_ROWS, -(-4 * sum(counts.values()) // BUCKETS))
    copies = [max(1, -(-counts.get(b, 0) // least)) for b in range(BUCKETS)]
    return copies if max(copies) > 1 else None


def join_salted(rows: DataFrame, table: DataFrame, key: str, hot: list[int] | None, spread_by: Column) -> DataFrame:
    """rows joined with ``table``, one row for each key, whose values may be large (texts).

    The table's rows of a hot bucket are copied as often as ``hot`` says and the bucket's rows are dealt over the copies:
    nothing is broadcast, and as a bucket has one in BUCKETS of the keys there are few further copies.
    """
    if hot is None:
        return rows.join(table, key)
    copies = F.element_at(F.lit(hot), _bucket(key) + 1)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), copies).cast("int"))
    each = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(each, [key, "_salt"]).drop("_salt")
