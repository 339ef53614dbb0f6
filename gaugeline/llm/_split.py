"""The hash rule that sets documents aside, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._names import fresh


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def sample_every(rows: DataFrame, group: str, key: str, text: str | None, each: int, most: int, few: int) -> DataFrame:
    """Rows of every value of ``group`` (strings), chosen by a hash of ``key``, or of ``text`` where the key is null.

    About ``each`` rows a value; where that makes more than ``most`` in all, fewer, but ``few`` at least, so the total
    grows with the values and none is left out.
    """
    counts = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    want = min(each, max(few, most // len(counts)))
    part, grp = fresh(rows, "share", "of")
    share = rows.sparkSession.createDataFrame([(k, min(1.0, want / n)) for k, n in counts.items()], f"{grp} string, {part} double")
    hashed = F.xxhash64(F.col(key), F.lit("sample"))
    if text is not None:
        hashed = F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.lit("sample"))).otherwise(hashed)
    place = F.pmod(hashed, F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.join(F.broadcast(share), F.col(group) == F.col(grp)).where(place < F.col(part)).select(*rows.columns)
