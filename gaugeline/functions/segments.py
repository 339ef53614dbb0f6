"""Segmentation criteria: objects that compile to Boolean columns."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass
from enum import StrEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.errors import PayloadTypeError, SegmentError

#: At most this many distinct values, or this share of the rows, make a numeric column categorical.
FEW_DISTINCT, DISTINCT_SHARE = 3, 0.05


class SegmentationType(StrEnum):
    Label = "Label"
    Threshold = "Threshold"


class ThresholdType(StrEnum):
    GreaterThan = "GreaterThan"
    GreaterThanEqualTo = "GreaterThanEqualTo"
    LessThan = "LessThan"
    LessThanEqualTo = "LessThanEqualTo"


def _not_nan(value: Column, kind: T.DataType | None) -> Column:
    """NaN fails every threshold."""
    return ~F.isnan(value) if kind is None or isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)


@dataclass(frozen=True)
class LabeledSegment:
    """Rows whose value equals ``value``."""

    value: Any

    def column(self, value: Column, kind: T.DataType | None = None) -> Column:
        return value == F.lit(self.value)


@dataclass(frozen=True)
class ThresholdSegment:
    """Rows whose value lies on the right side of ``value``; any orderable type."""

    value: Any
    threshold_type: ThresholdType | str

    def __post_init__(self) -> None:
        try:
            object.__setattr__(self, "threshold_type", ThresholdType(self.threshold_type))
        except ValueError:
            raise SegmentError(f"unknown threshold type {self.threshold_type!r}") from None

    def column(self, value: Column, kind: T.DataType | None = None) -> Column:
        t = F.lit(self.value)
        test = {
            ThresholdType.GreaterThan: value > t,
            ThresholdType.GreaterThanEqualTo: value >= t,
            ThresholdType.LessThan: value < t,
            ThresholdType.LessThanEqualTo: value <= t,
        }[self.threshold_type]
        numeric = isinstance(self.value, (int, float)) and not isinstance(self.value, bool)
        return _not_nan(value.cast("double") if kind is None else value, kind) & test if numeric else test


@dataclass(frozen=True)
class ColumnSegment:
    """Rows for which any Boolean column holds; the value it is applied to is ignored."""

    condition: Column

    def column(self, value: Column, kind: T.DataType | None = None) -> Column:
        return self.condition


Segment = LabeledSegment | ThresholdSegment | ColumnSegment


def segment(value: Any, segmentation_type: SegmentationType | str, threshold_type: ThresholdType | str | None = None) -> Segment:
    """A criterion from names: Label takes no threshold type, Threshold needs one."""
    try:
        kind = SegmentationType(segmentation_type)
    except ValueError:
        raise SegmentError(f"unknown segmentation type {segmentation_type!r}") from None
    if (kind is SegmentationType.Label) == (threshold_type is not None):
        raise SegmentError("a label takes no threshold type, a threshold needs one")
    return LabeledSegment(value) if kind is SegmentationType.Label else ThresholdSegment(value, threshold_type)


_PYTHON_TYPES = {
    bool: (T.BooleanType,),
    int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    float: (T.FloatType, T.DoubleType),
    str: (T.StringType, T.VarcharType, T.CharType),
}


@dataclass(frozen=True)
class Payload:
    """A column and its criterion, checked to be of one type."""

    column: str
    segment: Segment

    def resolve(self, df: DataFrame) -> Column:
        """The Boolean column; raises where the value's type is not the column's."""
        kind = df.schema[self.column].dataType
        value = getattr(self.segment, "value", None)
        if value is not None and type(value) in _PYTHON_TYPES and not isinstance(kind, _PYTHON_TYPES[type(value)]):
            raise PayloadTypeError(f"{self.column} is {kind.simpleString()}, its criterion's value {type(value).__name__}")
        return self.segment.column(F.col(self.column), kind)


_COMPARED = {
    ThresholdType.GreaterThan: operator.gt,
    ThresholdType.GreaterThanEqualTo: operator.ge,
    ThresholdType.LessThan: operator.lt,
    ThresholdType.LessThanEqualTo: operator.le,
}


def judged(criterion: Segment | Column | Payload, value: Any) -> bool | None:
    """The criterion for one Python value; None where only a column's semantics can tell (other types, NaN, conditions)."""
    criterion = criterion.segment if isinstance(criterion, Payload) else criterion
    if not isinstance(criterion, (LabeledSegment, ThresholdSegment)) or type(value) not in _PYTHON_TYPES:
        return None
    want = criterion.value
    if type(want) is not type(value) or value != value or want != want:
        return None
    return value == want if isinstance(criterion, LabeledSegment) else _COMPARED[criterion.threshold_type](value, want)


def is_categorical(distinct: int, rows: int, share: float = DISTINCT_SHARE) -> bool:
    return distinct <= FEW_DISTINCT or (rows > 0 and distinct / rows <= share)


#: Size of the sketch of distinct values (2^14 places) and the bound of its error that decides: seven times its deviation of 1.04 / 2^7.
SKETCH_BITS, SKETCH_SLACK = 14, 7 * 1.04 / 2**7


def categorical_columns(df: DataFrame, columns: Sequence[str], share: float = DISTINCT_SHARE) -> dict[str, bool]:
    """Whether each numeric column's distinct values are few enough for labels; nulls are left out.

    One scan sketches all columns at once and shuffles a sketch of 16 KB a column and partition. Columns whose estimate is
    within SKETCH_SLACK of the boundary are counted exactly, all in one more scan; the others are decided (a sketch is
    further off with a probability of about 1e-12). Only a column near the boundary shuffles its values.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    # adding 0.0 makes one value of both zeros; NaN are one value
    value = {c: F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c) for c in columns}
    sketched = [F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(value[c])), F.lit(SKETCH_BITS))).alias(f"d{i}") for i, c in enumerate(columns)]
    seen = df.agg(*sketched, *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out: dict[str, bool] = {}
    near = []
    for i, c in enumerate(columns):
        d, n = seen[f"d{i}"] or 0, seen[f"n{i}"]
        # one more or less for the rounding of the estimate
        sides = {is_categorical(max(0, math.floor(d * (1 - SKETCH_SLACK)) - 1), n, share), is_categorical(math.ceil(d * (1 + SKETCH_SLACK)) + 1, n, share)}
        if len(sides) == 1:
            out[c] = sides.pop()
        else:
            near.append((i, c))
    if near:
        exact = df.agg(*[F.count_distinct(value[c]).alias(f"d{i}") for i, c in near]).first()
        out |= {c: is_categorical(exact[f"d{i}"], seen[f"n{i}"], share) for i, c in near}
    return out


def heuristic_segments(df: DataFrame, labels: Sequence[tuple[str, Any]], share: float = DISTINCT_SHARE) -> list[Column]:
    """The criteria that bare labels (column, label) imply, in order; all numeric columns are looked at together.

    Booleans and strings are compared for equality; a numeric column with few distinct values too, any other numeric
    column by ``>=``. An integer column takes a float label cut to an integer.
    """
    wanted = []
    for column, label in labels:
        kind = df.schema[column].dataType
        if isinstance(kind, T.BooleanType):
            if not isinstance(label, (bool, int)):
                raise TypeError(f"{column} is boolean, the label {type(label).__name__}")
            wanted.append((column, kind, bool(label) if isinstance(label, bool) else label == 1))
        elif isinstance(kind, T.NumericType):
            if isinstance(label, str) or not isinstance(label, (int, float)):
                raise TypeError(f"{column} is numeric, the label {type(label).__name__}")
            wanted.append((column, kind, int(label) if isinstance(kind, T.IntegralType) else float(label)))
        else:
            if not isinstance(label, str):
                raise TypeError(f"{column} is a string, the label {type(label).__name__}")
            wanted.append((column, kind, label))
    few = categorical_columns(df, [c for c, kind, _ in wanted if isinstance(kind, T.NumericType)], share)
    return [F.col(c) == F.lit(v) if few.get(c, True) else ThresholdSegment(v, "GreaterThanEqualTo").column(F.col(c), kind) for c, kind, v in wanted]


def heuristic_segment(df: DataFrame, column: str, label: Any, share: float = DISTINCT_SHARE) -> Column:
    """``heuristic_segments`` of one column."""
    return heuristic_segments(df, [(column, label)], share)[0]
