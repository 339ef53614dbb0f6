"""Drift histograms by key in the state store: windows that close by rows or by time, and decay that touches what it must.

Values come as cells: the label of a baseline's dictionary (null for one it does not have), or the bin of a number. What
is known of a key is a weight for each cell that occurred, in map state, so a batch reads and writes the cells it has,
however many a dictionary holds. Results are cells too: scores are closed forms over them (``score_cells``), made by Spark
from the windows' rows and the baseline's table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeline.operators.drift import EPS, CategoricalBaseline, ContinuousBaseline, bin_column

#: The map key of values that the baseline does not have; cells of a baseline are kept behind a mark of their own.
OTHER, KNOWN = "-", "+"
#: A scale below which stored weights are written anew.
SMALLEST = 1e-120
#: Rows of ended windows that are counted at a time.
BLOCK = 200_000
_WINDOW = "started timestamp, ended timestamp, reason string, cell string, weight double, size double"
_STEP = "step long, updates long, cell string, weight double, size double"


def known_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """df with ``cell``: the value of ``column`` if the table ``labels`` (label, ...) has it, else null; null values are left out.

    The table is joined, as Spark sees fit, and may change between the batches of a stream.
    """
    have = labels.select(F.col("label").alias("_label"), F.col("label").alias("cell"))
    rows = df.where(F.col(column).isNotNull())
    return rows.join(have, F.col(column).cast("string") == F.col("_label"), "left").drop("_label")


def binned(df: DataFrame, column: str, baseline: ContinuousBaseline) -> DataFrame:
    """df with ``cell``, the value's bin; null values are left out."""
    return df.where(F.col(column).isNotNull()).withColumn("cell", bin_column(F.col(column).cast("double"), baseline.edges, baseline.n_bins).cast("string"))


def _stored(cell: Any) -> str:
    return OTHER if cell is None else KNOWN + cell


def _cell(stored: str) -> str | None:
    return None if stored == OTHER else stored[len(KNOWN) :]


def _counts(cells: pd.Series) -> dict[str, int]:
    """How often each cell occurs, as the map state names it."""
    have = cells[cells.notna()]
    out = {_stored(c): int(n) for c, n in have.value_counts().items()}
    return out | {OTHER: len(cells) - len(have)} if len(have) < len(cells) else out


class _Cells(StatefulProcessor):
    """Map state of weights."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weights = handle.getMapState("weights", "cell string", "weight double")

    def _add(self, counts: dict[str, float]) -> None:
        for cell, n in counts.items():
            have = self.weights.getValue((cell,))
            self.weights.updateValue((cell,), ((0.0 if have is None else float(have[0])) + n,))

    def _rows(self, head: dict[str, Any], key: Any, scale: float = 1.0) -> pd.DataFrame:
        have = [(_cell(k[0]), float(v[0]) * scale) for k, v in self.weights.iterator()]
        out = pd.DataFrame({"key": [str(key[0])] * len(have), **{c: [v] * len(have) for c, v in head.items() if c != "size"}})
        out["cell"], out["weight"] = pd.Series([c for c, _ in have], dtype=object), [w for _, w in have]
        out["size"] = head["size"]
        return out

    @staticmethod
    def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frames = list(rows)
        return pd.concat(frames) if len(frames) > 1 else frames[0]

    def close(self) -> None:
        """Nothing is held outside the state store."""


class WindowProcessor(_Cells):
    """A key's windows: one begins with its first row and ends after ``rate`` rows, or once ``cadence`` is over.

    A window's cells are emitted when it ends. With the clock ``event`` time is the rows' own: a row that is ``cadence`` or
    more after a window's first one ends it and begins the next; without such a row the watermark does. With the clock
    ``processing`` a row's time is that of its batch, and the wall clock ends windows. Either way a timer ends what no row
    ends, so a key that falls silent leaves the state. Rows of a batch are taken in order of time, then of ``order``.
    The state store is asked for the window that was open before a batch and the one that is open after it, however many
    windows lie between.
    """

    def __init__(self, rate: int, cadence: float, clock: str = "event"):
        self.rate, self.cadence, self.clock = int(rate), float(cadence), clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "started long, latest long, size long")

    def _end(self, key: Any, started: int, latest: int, size: int, reason: str) -> pd.DataFrame:
        head = {"started": pd.Timestamp(started, unit="us", tz="UTC"), "ended": pd.Timestamp(latest, unit="us", tz="UTC"), "reason": reason, "size": float(size)}
        out = self._rows(head, key)
        self.weights.clear()
        return out

    @staticmethod
    def _ordered(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Times and cells of a key's rows in order, twelve bytes a row: cells by their place in the list of names."""
        place, parts = {OTHER: 0}, []
        for data in rows:
            codes, cells = pd.factorize(data["cell"])
            # a null has the code -1, and so the last entry
            known = np.array([*(place.setdefault(_stored(c), len(place)) for c in cells), 0], np.int32)
            parts.append((data["at"].to_numpy(np.int64), data["turn"].to_numpy(np.int64), known[codes]))
        at, turn, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((turn, at))
        return at[order], codes[order], list(place)

    def _begins(self, at: np.ndarray, first: int) -> np.ndarray:
        """Where the windows begin, the first of them at the row ``first``, and each where the one before ends."""
        n, span, out = len(at), int(self.cadence * 1e6), [first]
        while True:
            stop = min(out[-1] + self.rate, n)
            due = at[out[-1]] + span
            if at[stop - 1] >= due:
                stop = int(at.searchsorted(due))
            if (stop := max(stop, out[-1] + 1)) >= n:
                return np.array(out)
            out.append(stop)

    def _ended(self, key: Any, at: np.ndarray, codes: np.ndarray, names: list[str], begins: np.ndarray) -> Iterator[pd.DataFrame]:
        """The windows that begin and end in one batch, counted without the state store, about ``BLOCK`` rows at a time."""
        cells, sizes, a = np.array([_cell(c) for c in names], object), np.diff(begins), 0
        while a < len(sizes):
            b = max(a + 1, int(begins.searchsorted(begins[a] + BLOCK, "right")) - 1)
            window = np.repeat(np.arange(a, b), sizes[a:b])
            pairs, weights = np.unique(window * len(names) + codes[begins[a] : begins[b]], return_counts=True)
            window, cell = np.divmod(pairs, len(names))
            times = {c: pd.to_datetime(at[i], unit="us", utc=True) for c, i in (("started", begins[window]), ("ended", begins[window + 1] - 1))}
            reason = np.where(sizes[window] >= self.rate, "rows", "time").astype(object)
            yield pd.DataFrame({"key": str(key[0]), **times, "reason": reason, "cell": cells[cell], "weight": weights.astype(float), "size": sizes[window].astype(float)})
            a = b

    def _keep(self, codes: np.ndarray, names: list[str]) -> None:
        """Adds the rows of the open window to the state."""
        self._add({names[c]: int(n) for c, n in enumerate(np.bincount(codes)) if n})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, codes, names = self._ordered(rows)
        if self.clock == "processing":
            at = np.full(len(at), int(timerValues.getCurrentProcessingTimeInMs()) * 1000)
        if self.window.exists():
            started, latest, size = (int(x) for x in self.window.get())
        else:
            started, latest, size = int(at[0]), int(at[0]), 0
        before, due, first = started, started + int(self.cadence * 1e6), 0
        if 0 < size < self.rate and at[0] < due:
            first = max(1, min(self.rate - size, int(at.searchsorted(due))))
            self._keep(codes[:first], names)
            size, latest = size + first, max(latest, int(at[first - 1]))
        if first < len(at):
            if size:
                yield self._end(key, started, latest, size, "rows" if size >= self.rate else "time")
            begins = self._begins(at, first)
            yield from self._ended(key, at, codes, names, begins)
            last = int(begins[-1])
            self._keep(codes[last:], names)
            started, latest, size = int(at[last]), int(at[-1]), len(at) - last
        self.window.update((started, latest, size))
        self._wake(before, started)

    def _wake(self, before: int, started: int) -> None:
        """A timer at the window's end, in place of the last window's."""
        due = [(t + int(self.cadence * 1e6) + 999) // 1000 for t in (before, started)]
        for t in list(self.handle.listTimers()):
            t = int(t[0]) if isinstance(t, (tuple, list)) else int(t)
            if t != due[1]:
                self.handle.deleteTimer(t)
        self.handle.registerTimer(due[1])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            started, latest, size = (int(x) for x in self.window.get())
            self.window.clear()
            if size:
                yield self._end(key, started, latest, size, "time")


class DecayProcessor(_Cells):
    """A key's weights, multiplied by ``factor`` at the end of each step.

    A stored weight is a weight divided by the key's scale, so a step changes one number and not the cells; rows of an
    earlier step that come late enter as what they would have become, in whatever order batches come. Emitted after every
    batch: all cells as of the end of the latest step, and a running number of updates.
    """

    def __init__(self, factor: float):
        self.factor = float(factor)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.scale = handle.getValueState("scale", "step long, scale double, size double, updates long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        data = self._gathered(rows)
        newest = int(data["step"].max())
        if self.scale.exists():
            step, scale, size, updates = self.scale.get()
            step, scale, size, updates = int(step), float(scale), float(size), int(updates)
        else:
            step, scale, size, updates = newest, 1.0, 0.0, 0
        if newest > step:
            passed = self.factor ** (newest - step)
            scale, size, step = scale * passed, size * passed, newest
            if scale < SMALLEST:
                for k, v in list(self.weights.iterator()):
                    self.weights.updateValue((k[0],), (float(v[0]) * scale,))
                scale = 1.0
        add: dict[str, float] = {}
        for s, part in data.groupby("step"):
            weight = self.factor ** (step - int(s))
            for cell, n in _counts(part["cell"]).items():
                add[cell] = add.get(cell, 0.0) + n * weight / scale
            size += len(part) * weight
        self._add(add)
        self.scale.update((step, scale, size, updates + 1))
        yield self._rows({"step": step, "updates": updates + 1, "size": size * self.factor}, key, scale * self.factor)


def flush_cells(stream: DataFrame, key: str, time: str, rate: int = 1_000_000, cadence: float = 86_400.0, delay: str = "0 seconds", order: str | None = None, clock: str = "event") -> DataFrame:
    """Ended windows (key, started, ended, reason, cell, weight, size) of a stream that has ``cell``, one row a cell that occurred.

    reason is ``rows`` or ``time``; clock: ``event`` or ``processing``. Rows with a null key or time are left out, with the
    event clock those behind the watermark (``delay`` after the latest) are dropped too; repeated rows count each. A key's rows of one batch are in one task's memory: bound a batch
    by the source's limits. Needs the RocksDB state store.
    """
    at = F.col(time).cast("timestamp")
    rows = stream.where(at.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), at.alias("_time"), F.unix_micros(at).alias("at"), (F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)) if order else F.lit(0).cast("long")).alias("turn"), "cell")
    if clock not in ("event", "processing"):
        raise ValueError(f"no such clock: {clock}")
    marked, mode = (rows.withWatermark("_time", delay), "EventTime") if clock == "event" else (rows.drop("_time"), "ProcessingTime")
    return marked.groupBy("key").transformWithStateInPandas(WindowProcessor(rate, cadence, clock), f"key string, {_WINDOW}", "Append", mode)


def decay_cells(stream: DataFrame, key: str, step: str, half_life: float) -> DataFrame:
    """(key, step, updates, cell, weight, size) after every batch of a stream that has ``cell``; ``step`` is a whole number.

    Rows of step k have been multiplied last - k + 1 times by 0.5 ** (1 / half_life), last being the key's latest step.
    Rows with a null key or step are left out. Needs the RocksDB state store.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(step).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), "cell")
    return rows.groupBy("key").transformWithStateInPandas(DecayProcessor(0.5 ** (1.0 / half_life)), f"key string, {_STEP}", "Append", "None")


def latest_cells(updates: DataFrame) -> DataFrame:
    """Of what ``decay_cells`` emitted, each key's latest state."""
    last = updates.groupBy("key").agg(F.max("updates").alias("updates"))
    return updates.join(last, ["key", "updates"], "left_semi")


def score_cells(cells: DataFrame, baseline: CategoricalBaseline | ContinuousBaseline, by: Sequence[str], eps: float = EPS) -> DataFrame:
    """(by..., metric, value): the drift metrics of each group's cells (cell, weight) against the baseline.

    Only cells that occurred are read; what a baseline's other labels or bins add is a closed form, see ``operators.drift``.
    """
    if isinstance(baseline, ContinuousBaseline):
        return baseline.score_weights(cells.select(*by, F.col("cell").cast("int").alias("bin"), F.col("weight").alias("c")), by, eps)
    return baseline.score_weights(cells.select(*by, F.col("cell").alias("label"), F.col("weight").alias("c")), by, eps)
