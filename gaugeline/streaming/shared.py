"""Folders that driver and executors share, and replays of finite streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one, which only a local master may have."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        top = f"file://{tempfile.gettempdir()}/gaugeline-shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Runs a finite stream to its end and returns the rows it appended; timers and open rows beyond its last watermark stay open.

    A stream with timers of the wall clock has no end and is none for this.
    State lies in RocksDB, as keyed processors need it; the session's own choice is put back afterwards.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
