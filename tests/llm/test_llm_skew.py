import pytest
from pyspark.sql import functions as F

from gaugeline.llm import _skew


@pytest.mark.parametrize("hot_rows", [1, 5, 10**6])
@pytest.mark.parametrize("all_rows", [True, False])
def test_join_is_the_same_for_hot_and_cold_keys(spark, monkeypatch, hot_rows, all_rows):
    monkeypatch.setattr(_skew, "HOT_ROWS", hot_rows)
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i % 11, i) for i in range(200)], "k int, i int")
    table = rows.where("k <> 4").groupBy("k").agg(F.count("*").alias("members"), F.max("i").alias("top"), F.lit(None).cast("string").alias("void"))
    got = _skew.join_by_key(rows, table, ["k"], 200, F.col("i"), all_rows=all_rows)
    want = rows.join(table.drop("members"), "k", "left" if all_rows else "inner").select("k", "i", "top", "void")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_single_and_no_rows(spark):
    rows = spark.range(10).select(F.col("id").alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("members"))
    assert _skew.join_by_key(rows, table, ["k"], 10, F.col("k")).count() == 10
    assert _skew.join_by_key(rows.limit(0), table, ["k"], 0, F.col("k")).count() == 0


def _half_on_one_key(spark, n=20_000):
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 997).alias("k"), F.col("id").alias("i"))
    table = rows.groupBy("k").agg(F.count("*").alias("members"), F.max("i").alias("top"))
    return rows, table


def test_the_salt_is_part_of_the_shuffle(spark):
    rows, table = _half_on_one_key(spark)
    out = _skew.join_by_key(rows, table, ["k"], 20_000, F.col("i"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "LeftOuter" in line and "_salt" in line)
    # both sides' salts are compared; a constant would leave the left one only, outside the keys
    assert join.count("_salt#") == 2


def test_no_partition_holds_a_hot_key(spark, tmp_path):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("50", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        rows, table = _half_on_one_key(spark)
        rows.write.parquet(f"{tmp_path}/rows")
        table.write.parquet(f"{tmp_path}/table")
        out = _skew.join_by_key(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/table"), ["k"], 20_000, F.col("i"))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and len(sizes) == 50
    assert max(sizes) < 3 * 20_000 / 50
