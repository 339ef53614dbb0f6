"""Where data comes from and reports go: in-memory columns, files, and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.errors import DriftInputError, EmptyDatasetError, NonUniformTypeError
from gaugeline.functions.metrics import FAMILIES


def check_uniform(values: Sequence[Any] | np.ndarray, name: str = "column") -> None:
    """Raises unless the values are of one type and at least one."""
    if isinstance(values, np.ndarray):
        if values.ndim != 1:
            raise NonUniformTypeError(f"{name} has {values.ndim} dimensions")
        if not values.size:
            raise EmptyDatasetError(f"{name} is empty")
        return
    if not len(values):
        raise EmptyDatasetError(f"{name} is empty")
    first = type(values[0])
    if any(not isinstance(v, first) for v in values):
        raise NonUniformTypeError(f"{name} mixes types")


def from_columns(spark: SparkSession, **columns: Sequence[Any] | np.ndarray) -> DataFrame:
    """A DataFrame from lists or arrays of equal length, aligned by position; other objects are taken as text."""
    plain = {}
    for name, values in columns.items():
        check_uniform(values, name)
        if not isinstance(values, np.ndarray) and not isinstance(values[0], (bool, int, float, str, np.generic)):
            values = [str(v) for v in values]
        plain[name] = values
    if len({len(v) for v in plain.values()}) > 1:
        raise ValueError("columns differ in length: " + ", ".join(f"{k} {len(v)}" for k, v in plain.items()))
    return spark.createDataFrame(pd.DataFrame(plain))


def column_type(df: DataFrame, column: str) -> str:
    """Float, Integer, Boolean or String: how a column is treated; anything else counts as String."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float"
    return "Integer" if isinstance(kind, T.IntegralType) else "Boolean" if isinstance(kind, T.BooleanType) else "String"


def require_float(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as doubles; raises TypeError where one is not of a floating type."""
    for c in columns:
        if column_type(df, c) != "Float":
            raise TypeError(f"{c} must be of a floating type, is {df.schema[c].dataType.simpleString()}")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def require_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as doubles; raises TypeError where one is not a number."""
    for c in columns:
        if column_type(df, c) not in ("Float", "Integer"):
            raise TypeError(f"{c} must be a number, is {df.schema[c].dataType.simpleString()}")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def drift_values(df: DataFrame, column: str) -> DataFrame:
    """A column as doubles for continuous drift; raises where a value that is not null cannot be read as a number."""
    out = df.withColumn(column, F.expr(f"try_cast(`{column}` as double)"))
    if df.where(F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` as double) is null")).limit(1).count():
        raise DriftInputError(f"{column} holds values that are not numbers")
    return out


def drift_labels(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """Any source that Spark reads; JSON and CSV want a schema, so that no pass over the data infers one."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_report(report: DataFrame, path: str, kind: str = "parquet", mode: str = "append") -> None:
    report.write.format(kind).mode(mode).save(path)


def read_report(spark: SparkSession, path: str, kind: str = "parquet", by: Mapping[str, str] | None = None) -> DataFrame:
    """A stored report (by..., metric, value)."""
    groups = "".join(f"`{k}` {v}, " for k, v in (by or {}).items())
    return spark.read.format(kind).schema(f"{groups}metric string, value double").load(path)


def performance_report(model_type: str, values: Mapping[str, float]) -> dict:
    """The tagged form {"model_type", "performance_data"}; extra or missing metrics raise."""
    from gaugeline.errors import InvalidReportError

    names = FAMILIES.get(str(model_type))
    if names is None or model_type in ("data_bias", "model_bias"):
        raise InvalidReportError(f"unknown model type {model_type!r}")
    if set(values) != set(names):
        raise InvalidReportError(f"{model_type}: missing {sorted(set(names) - set(values))}, unknown {sorted(set(values) - set(names))}")
    return {"model_type": str(model_type), "performance_data": {m: float(values[m]) for m in names}}
