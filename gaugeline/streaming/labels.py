"""Labels that come after their predictions: outer rows for those that never come, corrections for those that come late.

A prediction waits for its label for ``within``. It is counted with the label if that comes in time, and without one once
its time is over. A label that comes after that, but within ``grace``, takes the count without a label back and adds one
with it. All of this is a table of changes: rows that count +1 or -1, whose sums are right at any moment.

Both steps are interval joins, on batches as on streams. On a stream the two watermarks bound what is held: predictions
for ``grace`` and labels for as long as an older prediction may still come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.cells import CONFUSION_CELLS

LABELLED, UNLABELLED, LATE = "labelled", "unlabelled", "late"


def label_changes(predictions: DataFrame, truths: DataFrame, key: str, predicted_at: str, labelled_at: str, within: str, grace: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """predictions with the columns of truths (all but the key), ``status`` and ``change``.

    * ``labelled``, +1: the label came no later than ``within`` after its prediction;
    * ``unlabelled``, +1: it did not (label columns are null);
    * ``unlabelled``, -1 and ``late``, +1: it came afterwards, but no later than ``grace``.

    within, grace, delay: intervals, such as ``6 hours``. On streams rows may be ``delay`` behind the latest of their table,
    later ones are dropped; a prediction is given up when both watermarks have passed its time.

    A key has one label; of several within the same batch table the earliest counts, and on a stream the first that
    arrives while its watermark holds. Predictions of one key are rows of their own, also repeated ones. One without a key
    is unlabelled, one without a time is left out, as is a label without key or time, or from before its prediction.
    """
    given = [c for c in truths.columns if c != key]
    if clash := {c.lower() for c in given} & {c.lower() for c in predictions.columns}:
        raise ValueError(f"columns that both tables have: {sorted(clash)}")
    p = predictions.withColumn(predicted_at, F.col(predicted_at).cast("timestamp")).where(F.col(predicted_at).isNotNull())
    t = truths.withColumn(labelled_at, F.col(labelled_at).cast("timestamp")).where(F.col(labelled_at).isNotNull() & F.col(key).isNotNull())
    if predictions.isStreaming:
        p, t = p.withWatermark(predicted_at, delay), t.withWatermark(labelled_at, delay).dropDuplicatesWithinWatermark([key])
    else:
        first = F.min_by(F.struct(*given), F.struct(labelled_at, *[c for c in given if c != labelled_at]))
        t = t.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")
    t = t.withColumnRenamed(key, "_label_key")

    def after(interval: str) -> Column:
        return F.col(predicted_at) + F.expr(f"interval {interval}")

    same = (F.col(key) == F.col("_label_key")) & (F.col(labelled_at) >= F.col(predicted_at))
    names = [*predictions.columns, *given]
    counted = p.join(t, same & (F.col(labelled_at) <= after(within)), "left_outer")
    counted = counted.select(*names, F.when(F.col("_label_key").isNull(), UNLABELLED).otherwise(LABELLED).alias("status"), F.lit(1).alias("change"))
    if grace is None:
        return counted
    late = p.join(t, same & (F.col(labelled_at) > after(within)) & (F.col(labelled_at) <= after(grace)))
    steps = F.explode(F.array(F.struct(F.lit(UNLABELLED).alias("status"), F.lit(-1).alias("change")), F.struct(F.lit(LATE).alias("status"), F.lit(1).alias("change"))))
    late = late.select(*names, steps.alias("_step")).select(
        *predictions.columns, *[F.when(F.col("_step.status") == LATE, F.col(c)).alias(c) for c in given], "_step.status", "_step.change"
    )
    return counted.unionByName(late)


def changed_cells(changes: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tp, fp, tn, fn, unlabelled): sums of changes, which later changes may be added to.

    Rows with a status other than ``unlabelled`` whose truth or prediction is null are in no cell.
    """
    known = F.col("status") != UNLABELLED
    tests = {"tp": truth & pred, "fp": ~truth & pred, "tn": ~truth & ~pred, "fn": truth & ~pred}
    add = lambda test: F.coalesce(F.sum(F.when(test, F.col("change"))), F.lit(0)).cast("long")
    return changes.groupBy(*by).agg(*[add(known & tests[c]).alias(c) for c in CONFUSION_CELLS], add(~known).alias("unlabelled"))
