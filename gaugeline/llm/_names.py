"""Column names that cannot clash with those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each behind as many underscores as keep it apart from the table's columns (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def apart(df: DataFrame, *needed: str) -> DataFrame:
    """The same rows with all columns but the needed ones renamed to ``extra_0``, ``extra_1``, ... by their place.

    ``toDF(*df.columns)`` of a result with these columns in this order gives the names back.
    """
    return df.toDF(*[c if c in needed else f"extra_{i}" for i, c in enumerate(df.columns)])
