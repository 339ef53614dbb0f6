import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.errors import EmptyDatasetError, NonUniformTypeError
from gaugeline.functions import ieee
from gaugeline.sources import tables


def test_columns(spark):
    df = tables.from_columns(spark, i=[1, 2], f=np.array([0.5, 1.5]), s=["a", "b"], b=[True, False])
    assert [tables.column_type(df, c) for c in "ifsb"] == ["Integer", "Float", "String", "Boolean"]
    for bad, error in (({"a": []}, EmptyDatasetError), ({"a": [1, "x"]}, NonUniformTypeError), ({"a": np.zeros((2, 2))}, NonUniformTypeError), ({"a": [1], "b": [1, 2]}, ValueError)):
        with pytest.raises(error):
            tables.from_columns(spark, **bad)


def test_coercions(spark):
    df = tables.from_columns(spark, i=[1, 2], f=[0.5, 1.5], s=["1", "2.5"])
    assert tables.require_float(df, "f").schema["f"].dataType.simpleString() == "double"
    with pytest.raises(TypeError):
        tables.require_float(df, "i")
    with pytest.raises(TypeError):
        tables.require_numeric(df, "s")
    assert [r.s for r in tables.drift_values(df, "s").orderBy("s").collect()] == [1.0, 2.5]
    assert tables.drift_labels(df, "i").schema["i"].dataType.simpleString() == "string"


def test_ieee(spark):
    inf, nan = float("inf"), float("nan")
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 1.0), (1.0, nan), (6.0, 3.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(ieee.div(a, b).alias("d"), ieee.ln(a).alias("l"), ieee.sqrt(a).alias("s"), ieee.larger(a, b).alias("m"), ieee.gt(a, b).alias("g"), ieee.ge(a, b).alias("e"), ieee.lt(a, b).alias("t")).collect()
    same = lambda x, y: x == y or (x != x and y != y)
    for row, want in zip(rows, [(inf, 0.0, 1.0, 1.0, True), (-inf, nan, nan, 0.0, False), (nan, -inf, 0.0, 0.0, False), (nan, nan, nan, 1.0, False), (nan, 0.0, 1.0, 1.0, False), (2.0, 1.791759, 2.449489, 6.0, True)], strict=True):
        for got, w in zip(row[:5], want, strict=True):
            assert same(got, w) or abs(got - w) < 1e-5
    assert [r.e for r in rows] == [True, False, True, False, False, True]


def test_read_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    df = tables.read_table(spark, str(tmp_path / "a.csv"), "csv", "x int, y string", header=True)
    assert df.count() == 2 and tables.read_table(spark, "/root/testdata/sf0.001/nation.parquet").count() == 25
