"""Runtime cells of very many keys as a table: each batch appends its sums, a report adds them up.

A batch is combined before its shuffle, so a key with most of the rows is no burden, and writes one row a key that it
touched. It writes a folder of its own, named by its id and written anew if the batch is run again, so every batch counts
once, whatever fails. Folders are merged from time to time (``compact``); a merge names the last batch it holds, and
readers take the newest whole merge and the batches after it. Nothing of it is held by the driver.

``KeyedMonitor`` builds the five families' monitors on such a log: baselines come in versions, each from a time on, and a
row counts towards the version that held at its own time for its key, however late it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.errors import BaselineError
from gaugeline.functions import cells as C
from gaugeline.functions.metrics import DATA_BIAS, MODEL_BIAS
from gaugeline.operators import analysis
from gaugeline.operators.reports import STABILITY_EPS, THRESHOLD, drift_snapshot, snapshot_failures

#: The cells of each family.
FAMILY_CELLS = {
    DATA_BIAS: C.FACET_CELLS, MODEL_BIAS: C.MODEL_CELLS, analysis.BINARY: C.CONFUSION_CELLS,
    analysis.LOGISTIC: (*C.CONFUSION_CELLS, "penalty"), analysis.LINEAR: C.REGRESSION_CELLS,
}


class CellLog:
    """Sums (or maxima, of cells named ``max_``...) by key, appended batch by batch below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, by: Sequence[str], cells: Sequence[str]):
        self.spark, self.folder, self.by, self.cells = spark, folder.rstrip("/"), list(by), list(cells)

    def _numbers(self, kind: str) -> list[int]:
        """The ids of the whole folders of a kind: those whose write has ended."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        return rows.groupBy(*self.by).agg(*[(F.max(c) if c.startswith("max_") else F.sum(c)).alias(c) for c in self.cells])

    def append(self, counted: DataFrame, batch_id: int) -> None:
        """A batch's cells, one row a key; the same id again replaces them, and one that a merge holds already is left out."""
        held = self._numbers("merged")
        if held and batch_id <= held[-1]:
            return
        counted.select(*self.by, *self.cells).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")

    def foreach_batch(self, count: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: appends count(rows of the batch)."""
        return lambda df, batch_id: self.append(count(df), batch_id)

    def _parts(self) -> list[str]:
        held = self._numbers("merged")[-1:]
        later = [b for b in self._numbers("batches") if not held or b > held[0]]
        return [f"{self.folder}/merged/{m}" for m in held] + [f"{self.folder}/batches/{b}" for b in later]

    def is_empty(self) -> bool:
        return not self._parts()

    def last(self) -> int | None:
        """The largest id that was appended."""
        ids = self._numbers("merged")[-1:] + self._numbers("batches")[-1:]
        return max(ids) if ids else None

    def version_rows(self, batch_id: int) -> DataFrame:
        """The rows of one batch as it was appended; a log whose batches are read like this is not to be merged."""
        return self.spark.read.parquet(f"{self.folder}/batches/{batch_id}")

    def read(self) -> DataFrame:
        """The cells of every key so far; a log without batches has no schema yet and is refused."""
        parts = self._parts()
        if not parts:
            raise BaselineError("nothing was counted yet")
        return self.merged(self.spark.read.parquet(*parts))

    def compact(self) -> None:
        """Merges all whole batches. What was merged stays until the next merge, for those who read it now."""
        last = self._numbers("batches")
        held = self._numbers("merged")
        if not last or (held and held[-1] >= last[-1]):
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/merged/{last[-1]}")
        jvm = self.spark.sparkContext._jvm
        for kind, gone in (("batches", [b for b in last if held and b <= held[-1]]), ("merged", held[:-1])):
            for k in gone:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{k}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class KeyedMonitor:
    """A family's monitor for every value of ``keys``, with baselines in versions.

    count(df, by): the family's cells of df by group, as the functions of ``operators.analysis`` give them.
    time: the column that says when a row counts. A row with a null key or time is left out, as is one before its
    key's first baseline. State is the folder: a monitor that is made anew on it goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str, family: str, keys: Sequence[str], time: str, count: Callable[[DataFrame, Sequence[str]], DataFrame]):
        if family not in FAMILY_CELLS:
            raise ValueError(f"no family of cells: {family}")
        self.spark, self.family, self.keys, self.time, self.count = spark, family, list(keys), time, count
        self.by = [*self.keys, "version"]
        cells = FAMILY_CELLS[family]
        self.baselines = CellLog(spark, f"{folder}/baselines", [*self.by, "since"], cells)
        self.runtime = CellLog(spark, f"{folder}/runtime", self.by, cells)

    def reset_baseline(self, df: DataFrame, since: str, version: int) -> None:
        """A baseline of each key that df has, for rows from ``since`` on; other keys keep theirs.

        Versions are whole numbers in order of time. A version's runtime starts empty. Setting one again replaces it.
        Rows that were counted before this call stay with the version that held then.
        """
        known = df
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        cells = self.count(known, self.keys).withColumns({"version": F.lit(version), "since": F.lit(since).cast("timestamp")})
        self.baselines.append(cells, version)

    def reset(self, keys: DataFrame | None, since: str, version: int) -> None:
        """Starts the runtime of the given keys (all, if None) anew from ``since`` on, with the baseline they have."""
        latest = self._latest(self.baselines.read()).drop("version", "since")
        if keys is not None:
            latest = latest.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        self.baselines.append(latest.withColumns({"version": F.lit(version), "since": F.lit(since).cast("timestamp")}), version)

    def _latest(self, rows: DataFrame) -> DataFrame:
        packed = F.max_by(F.struct(*rows.columns), "version").alias("_last")
        return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]).agg(packed).select("_last.*")

    def counted(self, df: DataFrame) -> DataFrame:
        """A batch's cells by key and version: the versions of a key are a short list that its rows are compared with."""
        steps = F.sort_array(F.collect_list(F.struct("since", "version"))).alias("_steps")
        versions = self.baselines.read().groupBy(*self.keys).agg(steps)
        at = F.col(self.time).cast("timestamp")
        passed = F.filter("_steps", lambda s: s["since"] <= at)
        rows = df.where(at.isNotNull()).join(versions, self.keys).withColumn("_passed", passed).where(F.size("_passed") > 0)
        rows = rows.withColumn("version", F.element_at("_passed", -1)["version"])
        return self.count(rows.drop("_steps", "_passed"), self.by)

    def push_batch(self, df: DataFrame, batch_id: int) -> None:
        """Adds a batch; the same id again changes nothing."""
        self.runtime.append(self.counted(df), batch_id)

    def foreach_batch(self) -> Callable[[DataFrame, int], None]:
        return self.push_batch

    def performance(self) -> DataFrame:
        """(keys..., version, metric, value) of every version that has rows."""
        return analysis.finish(self.runtime.read(), self.family, self.by)

    def baseline_reports(self) -> DataFrame:
        return analysis.finish(self.baselines.read().drop("since"), self.family, self.by)

    def drift(self, metrics: Sequence[str] | None = None, eps: float = STABILITY_EPS) -> DataFrame:
        """(keys..., version, metric, value): how far each version's runtime is from its baseline."""
        return drift_snapshot(self.performance(), self.baseline_reports(), self.family, metrics, by=self.by, eps=eps)

    def failures(self, threshold: float = THRESHOLD, metrics: Sequence[str] | None = None) -> DataFrame:
        """What a report lists as failed, by key, of each key's latest version."""
        return snapshot_failures(self._latest_metric(self.drift(metrics)), threshold, by=self.by)

    def _latest_metric(self, rows: DataFrame) -> DataFrame:
        last = self.baselines.read().groupBy(*self.keys).agg(F.max("version").alias("version"))
        return rows.join(last, self.by, "left_semi")
