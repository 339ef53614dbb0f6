"""Categorical drift against a dictionary of any size: baseline and runtime are tables, merged batch by batch.

The driver holds no label. A batch is combined by label before its shuffle and written to a folder named by its id, so a
batch that is run again counts once (see ``celllog``); labels that the baseline does not know share the null label.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError, EmptyDatasetError
from gaugeline.operators.drift import EPS, CategoricalBaseline
from gaugeline.streaming.celllog import CellLog


class DictionaryMonitor:
    """A monitor of one column. State is the folder: a monitor made anew on it goes on where the last one ended.

    Values are taken as text, nulls are left out. ``compact_every`` batches are merged into one table. Folders are read by
    one writer's rules: one stream pushes, any number of others may score.
    """

    def __init__(self, spark: SparkSession, folder: str, column: str, eps: float = EPS, compact_every: int = 64):
        self.spark, self.column, self.eps, self.compact_every = spark, column, eps, compact_every
        self.baselines = CellLog(spark, f"{folder}/baselines", ["version", "label"], ["n"])
        self.runtime = CellLog(spark, f"{folder}/runtime", ["version", "label"], ["n"])

    def _counts(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.column).cast("string").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))

    def reset_baseline(self, df: DataFrame, version: int) -> None:
        """A new dictionary; its runtime starts empty. Versions are whole numbers, the largest one holds."""
        self.baselines.append(self._counts(df).withColumn("version", F.lit(version)), version)
        if self.baselines.version_rows(version).isEmpty():
            raise BaselineError("the baseline is empty")

    @property
    def version(self) -> int:
        """The version that holds."""
        last = self.baselines.last()
        if last is None:
            raise BaselineError("no baseline was set yet")
        return last

    def _dictionary(self) -> DataFrame:
        return self.baselines.version_rows(self.version).select("label", "n")

    def baseline(self) -> CategoricalBaseline:
        """Label shares as a table."""
        held = self._dictionary()
        sizes = held.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
        return CategoricalBaseline(held.select("label", (F.col("n") / F.lit(float(sizes["n"]))).alias("p")), sizes["k"])

    def push_batch(self, df: DataFrame, batch_id: int) -> None:
        """Adds a batch; the same id again changes nothing. The runtime has a row a label of the dictionary, and one more, at most."""
        known = self._dictionary().select("label", F.lit(True).alias("known"))
        told = self._counts(df).join(known, "label", "left").groupBy(F.when(F.col("known"), F.col("label")).alias("label")).agg(F.sum("n").alias("n"))
        self.runtime.append(told.withColumn("version", F.lit(self.version)), batch_id)
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.runtime.compact()

    def weights(self) -> DataFrame:
        """(label, n) counted since the baseline was set; the null label stands for all that it does not know."""
        if self.runtime.is_empty():
            raise EmptyDatasetError("nothing was pushed yet")
        return self.runtime.read().where(F.col("version") == self.version).select("label", "n")

    def drift(self, metrics: Iterable[str] | None = None) -> DataFrame:
        """(metric, value); no rows where nothing was counted since the baseline was set."""
        return self.baseline().score_weights(self.weights().withColumnRenamed("n", "c"), eps=self.eps, metrics=metrics)

    def snapshot(self) -> DataFrame:
        """(label, p, n): every label of the dictionary with its baseline share and runtime count; a null label, if any came, has p = 0."""
        both = self.baseline().labels.alias("b").join(self.weights().alias("w"), F.col("b.label").eqNullSafe(F.col("w.label")), "full_outer")
        return both.select(F.coalesce("b.label", "w.label").alias("label"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def total_samples(self) -> int:
        return self.weights().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
