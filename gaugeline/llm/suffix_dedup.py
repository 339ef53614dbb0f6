"""Repeated byte strings across a corpus: routed segments, then external induced sorting of each shard.

Two equal strings of ``length`` bytes hold the same smallest hash of their ``GRAM``-byte strings. So every window of
``length`` bytes is routed by that hash, runs of windows with one hash make a segment, and all windows that can
be equal meet in one shard. A hash that occurs once, in a segment that holds it once, cannot repeat and is dropped;
equal segments are reduced to one with a count before anything is moved; where a hash has no other segment, all windows
of this one are repeated and there is nothing to sort. A hash whose segments exceed HOT_BYTES (those
around a common header, say) is split: its segments are routed again, by strings twice as long and at last by whole
windows. Each shard's segments are sorted by external induced sorting, and a window is repeated where its common prefix
with a neighbour reaches ``length`` or where its segment occurs more than once. A window reaches far to the left or to
the right of its segment's smallest hash; segments that agree with no other one of their hash on either side share no
window and are not sorted.

Shards are small next to a partition: a task sorts its partition by shard (Spark spills that), then takes one shard after
another, small ones together, so partitions may hold hundreds of MB and their number does not follow the number of shards.
A shard's bytes, symbols, types, names, seeds and flags lie in memory-mapped files beyond SORT_BUDGET, its tuples in
queues that spill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._skew import join_by_key
from gaugeline.llm._store import Scratch, partitions
from gaugeline.llm._text import _M_INV, BYTE_HASH, U64, chunks, powers, prefix_hash, span_hash, string_buffers
from gaugeline.llm.induced import Files, Spool, repeated_starts

GRAM = 32
#: Bytes of segments that a shard is planned for; a larger shard is sorted too, through files.
SHARD_BYTES = 2 << 20
#: Bytes of segments in a partition, a run of shards, at most on average.
PARTITION_BYTES = 256 << 20
#: Bytes of distinct segments of one hash above which they are routed again by longer strings.
HOT_BYTES = SHARD_BYTES
#: Memory for the tuples of each queue of a shard's sort, and for each of its arrays; the rest lies in files.
SORT_BUDGET = 1 << 20
#: Strings of names that a shard's sort orders in memory, about 100 bytes a name; longer ones are sorted by recursion.
BASE_CASE = 2 << 20
#: Windows in a segment at most; a longer run (a text that repeats itself) is cut into several of the same hash.
RUN = 4096
#: Places whose sliding minima are made at a time, so that the steps between stay in a core's cache.
SLIDE = 1 << 16


def _sliding(least, x: np.ndarray, width: int) -> np.ndarray:
    """least (np.minimum or np.maximum) of each ``width`` neighbours, by doubling, SLIDE of them at a time."""
    out = np.empty(len(x) - width + 1, x.dtype)
    for i in range(0, len(out), SLIDE):
        part, have = x[i : i + SLIDE + width - 1], 1
        while have * 2 <= width:
            part = least(part[: len(part) - have], part[have:])
            have *= 2
        rest = width - have
        out[i : i + SLIDE] = least(part[: len(part) - rest], part[rest:]) if rest else part
    return out


def _gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes from each place on."""
    with np.errstate(over="ignore"):
        low = prefix[gram:] - prefix[:-gram]
        # of the polynomial value times its inverse power; one multiply-xorshift spreads it
        low = low * powers(_M_INV, len(low))
        low ^= low >> U64(31)
        low *= U64(0x9E3779B97F4A7C15)
        low ^= low >> U64(29)
    return low


def _segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(start, windows, routing hash, hash of the bytes, whether it may repeat within itself) of a chunk's segments."""
    n = len(data)
    if n < length:
        return None
    prefix = prefix_hash(BYTE_HASH[data])
    low = _gram_hashes(prefix, gram)
    width = length - gram + 1
    grams, low = low, _sliding(np.minimum, low, width)
    size = np.diff(at)
    edge = np.zeros(len(low) + 1, dtype=np.int32)
    long = size >= length
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    head = valid.copy()
    head[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    opens = at[:-1][long]
    head[opens] = True
    start = np.flatnonzero(head)
    if not len(start):
        return None
    # a run ends at the next head or at the next window that is not valid
    stop = np.append(start[1:], len(low))
    tail = valid & np.append(~valid[1:], True)
    stop = np.minimum(stop, np.flatnonzero(tail)[np.searchsorted(np.flatnonzero(tail), start)] + 1)
    run = stop - start
    if run.max() > RUN:
        pieces = -(-run // RUN)
        base = np.repeat(start, pieces)
        step = (np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        run = np.minimum(RUN, np.repeat(run, pieces) - step)
        start = base + step
    # the places of the smallest hashes, and which runs hold theirs more than once
    padded = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
    place = np.flatnonzero(grams == _sliding(np.maximum, padded, width))
    at_place, key = grams[place], low[start]
    first, end = np.searchsorted(place, start), np.searchsorted(place, start + run + width - 1)
    seen, todo = np.zeros(len(start), dtype=np.int64), np.arange(len(start))
    while len(todo):
        seen[todo] += at_place[first[todo]] == key[todo]
        first[todo] += 1
        todo = todo[(seen[todo] < 2) & (first[todo] < end[todo])]
    return start, run, key, span_hash(prefix, start, start + run + length - 1), seen > 1


def _routed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each segment: (key, seg, row_a, row_b, start, n, twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(2)):
                found = _segments(data, at, length, gram)
                if found is None:
                    continue
                start, n, key, seg, twice = found
                doc = np.searchsorted(at, start, side="right") - 1
                pick = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array((start - at[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["key", "seg", "row_a", "row_b", "start", "n", "twice"],
                )

    return docs.select("row_a", "row_b", "text").mapInArrow(run, "key long, seg long, row_a long, row_b long, start int, n int, twice boolean")


def _flanks(body: pa.Array, key: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each segment's bytes before and after the string of its routing hash, half of what a window has besides it.

    A side that is shorter gives 0, and both sides are 1 where the hash occurs more than once.
    """
    half = (length - gram + 1) // 2
    out = np.zeros((2, len(body)), dtype=U64)
    for lo, hi, data, at in chunks(body):
        prefix = prefix_hash(BYTE_HASH[data])
        low = _gram_hashes(prefix, gram)
        owner = np.repeat(np.arange(hi - lo), np.diff(at))[: len(low)]
        place = np.flatnonzero((low == key[lo:hi].view(U64)[owner]) & (np.arange(len(low)) + gram <= at[1:][owner]))
        count = np.bincount(owner[place], minlength=hi - lo)
        assert count.all()
        first = place[np.cumsum(count) - count]
        for side, a in zip(out, (first - half, first + gram), strict=True):
            fits = (a >= at[:-1]) & (a + half <= at[1:])
            side[lo:hi][fits] = span_hash(prefix, a[fits], a[fits] + half) | U64(2)
            side[lo:hi][count > 1] = 1
    return out[0].view(np.int64), out[1].view(np.int64)


def _sortable(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which segments may share a window with another one of their hash, or hold one twice; all segments of each hash are here."""
    again = left == 1
    out = np.isin(key, key[again]) if again.any() else again.copy()
    for side in (left, right):
        have = np.flatnonzero((side != 0) & ~again)
        # two that fall on one number are sorted in vain, no more
        with np.errstate(over="ignore"):
            both = key[have].view(U64) * U64(0x9E3779B97F4A7C15) + side[have].view(U64)
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        out[have[count[which] > 1]] = True
    return out


def _whole_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, those of one hash (neighbours in the order) in one batch."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield joined()
            held = []
        other = np.flatnonzero(key != key[-1])
        if len(other):
            held.append(batch.slice(0, int(other[-1]) + 1))
            yield joined()
            held = []
            batch = batch.slice(int(other[-1]) + 1)
        held.append(batch)
    if held:
        yield joined()


def _cut(wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the wanted segments: (key, seg, copies, n, hot, left, right, body)."""
    names = ["key", "seg", "copies", "n", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(0)):
                lists = batch.column(1).slice(lo, hi - lo)
                rows = lists.flatten()
                doc = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
                start = (rows.field("start").to_numpy() + at[doc]).tolist()
                end = (rows.field("n").to_numpy() + (length - 1)).tolist()
                raw = data.tobytes()
                body = pa.array([raw[a : a + k] for a, k in zip(start, end, strict=True)], pa.binary())
                sides = _flanks(body, rows.field("key").to_numpy(), length, gram)
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names), *map(pa.array, sides), body], [*names, "left", "right", "body"])

    return wanted.mapInArrow(run, "key long, seg long, copies long, n int, hot boolean, left long, right long, body binary")


def _sorted_shards(segments: DataFrame, length: int, shards: int, spread: int) -> DataFrame:
    """Sorts the segments of each shard: (key, seg, runs) with the runs of repeated windows, for segments that have some.

    segments: (key, seg, copies, n, left, right, body), each (key, seg) once. A hash's segments lie in one shard, shards in
    one partition of ``spread`` each. A task holds one hash's segments and one shard's names and counts at a time; the bytes
    to sort are spooled. Shards of which little is left to sort are sorted together with the next one.
    """
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(spread, "shard").sortWithinPartitions("shard", "key")
    budget, base_case, enough = SORT_BUDGET, BASE_CASE, SHARD_BYTES // 2

    def sort(held: list[pa.RecordBatch], spool: Spool) -> Iterator[pa.RecordBatch]:
        meta = pa.Table.from_batches(held)
        n = meta["n"].to_numpy()
        flag, start, _ = repeated_starts(spool, length, base_case=base_case)
        # every window of a segment that occurs more than once is repeated
        for i in np.flatnonzero(meta["copies"].to_numpy() > 1):
            flag[start[i] : start[i] + n[i]] = True
        step = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        owner = np.searchsorted(start, a, side="right") - 1
        # a run that is flagged reaches at most to the segment's last window, so it has one owner
        assert (b - start[owner] <= n[owner]).all()
        have = np.unique(owner)
        count = np.bincount(owner, minlength=len(n))[have]
        runs = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((a - start[owner]).astype(np.int32)), pa.array((b - start[owner]).astype(np.int32))], ["a", "b"]),
        )
        pick = pa.array(have)
        yield from pa.table({"key": meta["key"].take(pick), "seg": meta["seg"].take(pick), "runs": runs}).to_batches(max_chunksize=5000)

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(3).to_numpy()
        ends = np.zeros(len(n), np.int32), n.astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32)), pa.StructArray.from_arrays([*map(pa.array, ends)], ["a", "b"]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs], ["key", "seg", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, spool = None, None
        for batch in _whole_hashes(batches):
            key, copies, left, right, of = (batch.column(i).to_numpy() for i in (0, 2, 4, 5, 7))
            sortable = _sortable(key, left, right)
            yield alone(batch.filter(pa.array(~sortable & (copies > 1))))
            batch, of = batch.filter(pa.array(sortable)), of[sortable]
            edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if spool is None or of[a] != shard and spool.bytes >= enough:
                    if spool is not None:
                        yield from sort(held, spool)
                    spool, held = Spool(Files(None, budget)), []
                shard = of[a]
                part = batch.slice(a, b - a)
                spool.add(*string_buffers(part.column(6)))
                held.append(part.select(["key", "seg", "copies", "n"]))
        if spool is not None:
            yield from sort(held, spool)

    return dealt.select("key", "seg", "copies", "n", "left", "right", "body", "shard").mapInArrow(run, "key long, seg long, runs array<struct<a:int,b:int>>")


def _cut_out(body: np.ndarray, a: np.ndarray, b: np.ndarray, whole_characters: bool) -> tuple[bytes, int, int]:
    """body without the bytes [a, b): what is left, how many bytes went, in how many maximal runs."""
    if not len(a):
        return body.tobytes(), 0, 0
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.concatenate([[True], a[1:] > b[:-1]])
    a, b = a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]
    if whole_characters:
        # a character is cut whole or stays whole
        heads = np.flatnonzero(np.append((body & 0xC0) != 0x80, True))
        a, b = heads[np.searchsorted(heads, a)], heads[np.searchsorted(heads, b, side="right") - 1]
        a, b = a[b > a], b[b > a]
    keep = np.ones(len(body) + 1, dtype=np.int8)
    np.add.at(keep, a, -1)
    np.add.at(keep, b, 1)
    keep = np.cumsum(keep[:-1] - 1) + 1 if len(body) else keep[:0]
    return body[keep > 0].tobytes(), int((b - a).sum()), len(a)


def _without(joined: DataFrame, length: int, whole_characters: bool) -> DataFrame:
    """Cuts the covered bytes out of each row's text."""
    carried = [c for c in joined.schema.fieldNames() if c not in ("text", "spans")]
    places = {c: joined.schema.fieldNames().index(c) for c in (*carried, "text", "spans")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last_row, data, at in chunks(batch.column(places["text"])):
                part = batch.slice(first, last_row - first)
                lists = part.column(places["spans"])
                flat = lists.flatten()
                begin, stop = flat.field("a").to_numpy(), flat.field("b").to_numpy()
                by = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(False).astype(np.int64))])
                kept, removed, spans = [], [], []
                for i in range(part.num_rows):
                    body = data[at[i] : at[i + 1]]
                    text, n, k = _cut_out(body, begin[by[i] : by[i + 1]].astype(np.int64), stop[by[i] : by[i + 1]].astype(np.int64) + (length - 1), whole_characters)
                    kept.append(text)
                    removed.append(n)
                    spans.append(k)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(places[c]) for c in carried), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    [*carried, "n_bytes", "n_removed", "n_spans", "kept"],
                )

    schema = T.StructType([f for f in joined.schema if f.name in carried])
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(run, schema)


def _repeated(scratch: Scratch, rows: DataFrame, length: int, gram: int, level: int = 0) -> DataFrame:
    """Repeated windows of rows (row_a, row_b, text), each (row_a, row_b) once: (row_a, row_b, runs), a row for each segment that holds some."""
    table = "{}-" + str(level)
    spread = F.xxhash64("row_a", "row_b", "start")
    routed = scratch.keep(_routed(rows, length, gram), table.format("routed"))
    n_routed = routed.count()
    # segments of one kind that are alone with their hash: all their windows are repeated
    same = (F.min("seg") == F.max("seg")) & (F.count("*") > 1)
    keys = routed.groupBy("key").agg(F.count("*").alias("members"), F.max("twice").alias("repeats"), same.alias("same")).where("members > 1 or repeats").select("key", "members", "same")
    crowd = join_by_key(routed.drop("twice"), scratch.keep(keys, table.format("keys")), ["key"], n_routed, spread)
    crowd = scratch.keep(crowd, table.format("crowd"))
    scratch.drop(table.format("routed"), table.format("keys"))
    alone = crowd.where("same").select("row_a", "row_b", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))).alias("runs"))
    crowd = crowd.where("not same").drop("same")
    unique = crowd.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("row_a", "row_b", "start", "n")).alias("rep"))
    unique = scratch.keep(unique.select("key", "seg", "copies", "rep.*"), table.format("unique"))
    # equal windows share their strings of any length too, so a hot hash's segments part exactly; whole windows end it
    size = F.sum(F.col("n") + F.lit(length - 1))
    hot = unique.groupBy("key").agg(F.count("*").alias("members"), size.alias("bytes")).where(F.col("bytes") > HOT_BYTES)
    hot = None if gram == length else scratch.keep(hot.select("key", "members", F.lit(True).alias("hot")), table.format("hot"))
    if hot is not None and hot.isEmpty():
        hot = None
    marked = unique.withColumn("hot", F.lit(None).cast("boolean")) if hot is None else join_by_key(unique, hot, ["key"], unique.count(), F.col("seg"), all_rows=True)
    wanted = marked.groupBy("row_a", "row_b").agg(F.collect_list(F.struct("start", "n", "key", "seg", "copies", "hot")).alias("parts"))
    bodies = _cut(rows.join(wanted.hint("shuffle_hash"), ["row_a", "row_b"]).select("text", "parts"), length, gram)
    cold, deep, measured = bodies, None, unique
    if hot is not None:
        # texts are read once for both kinds
        bodies = scratch.keep(bodies, table.format("bodies"))
        cold, deep = bodies.where("hot is null"), bodies.where("hot")
        measured = cold
    volume = measured.agg(size).first()[0] or 0
    shards = max(1, math.ceil(volume / SHARD_BYTES))
    tasks = min(shards, max(partitions(rows.sparkSession), math.ceil(volume / PARTITION_BYTES)))
    found = scratch.keep(_sorted_shards(cold.drop("hot"), length, shards, tasks), table.format("found"))
    if deep is not None:
        # segments are the next level's rows; those that occur more than once repeat from end to end
        inner = deep.select(F.col("key").alias("row_a"), F.col("seg").alias("row_b"), F.col("body").alias("text"))
        inner = _repeated(scratch, inner, length, min(2 * gram, length), level + 1).withColumnsRenamed({"row_a": "key", "row_b": "seg"})
        whole = deep.where("copies > 1").select("key", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
        inner = inner.unionByName(whole).groupBy("key", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        found = found.unionByName(inner)
    found = found.join(unique.select("key", "seg", F.col("copies").alias("members")), ["key", "seg"])
    spans = join_by_key(crowd, scratch.keep(found, table.format("runs")), ["key", "seg"], n_routed, spread)
    return alone.unionByName(spans.select("row_a", "row_b", F.expr("transform(runs, x -> struct(x.a + start as a, x.b + start as b))").alias("runs")))


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    gram: int = GRAM,
    whole_characters: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: (id, carried columns, n_bytes, n_removed, n_spans, kept).

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in any document, is removed;
    strings are judged on the input and never cross documents. ``kept`` holds the remaining bytes; n_spans counts
    maximal removed runs. A null text counts as empty; a null id and repeated ids or rows are rows like any other.
    A row (id and text) that occurs twice repeats itself, so all of it goes if it has ``length`` bytes; it takes part in
    the search once. Very long texts are read in one piece, their segments are not longer than others. With
    ``whole_characters`` a removed run is narrowed to whole UTF-8 characters, so that ``kept`` is text. Columns
    other than those named are not read; carried ones may have any name but those of the result.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    added = ("id", "n_bytes", "n_removed", "n_spans", "kept")
    if clash := {c.lower() for c in carry} & set(added):
        raise ValueError(f"carried columns named as columns of the result: {sorted(clash)}")
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a row is known by its id and a hash of its text
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("int")).alias("carried"),
        text.alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))).alias("row_a"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("row_b"),
    )
    row = ["row_a", "row_b"]
    times = scratch.keep(base.groupBy(*row).agg(F.count("*").alias("members")).where("members > 1").withColumn("again", F.lit(True)), "times")
    once, again = base, None
    if not times.isEmpty():
        marked = join_by_key(base, times, row, base.count(), F.monotonically_increasing_id(), all_rows=True)
        once, again = marked.where("again is null").drop("again"), marked.where("again").drop("again")
    distinct = once.select(*row, "text")
    if again is not None:
        # one text for each, combined before the shuffle
        distinct = distinct.unionByName(scratch.keep(again.groupBy(*row).agg(F.first("text").alias("text")), "distinct"))
    spans = _repeated(scratch, distinct, length, gram)
    # runs that are given twice (by two levels) are left to the cut: array_distinct compares each with all others
    per_row = spans.groupBy(*row).agg(F.flatten(F.collect_list("runs")).alias("spans"))
    joined = once.join(per_row.hint("shuffle_hash"), row, "left").select("id", "carried", "text", "spans")
    if again is not None:
        size = F.octet_length("text")
        whole = F.when(size >= length, F.array(F.struct(F.lit(0).alias("a"), (size - F.lit(length - 1)).alias("b"))))
        joined = joined.unionByName(again.select("id", "carried", "text", whole.alias("spans")))
    out = _without(joined, length, whole_characters)
    return out.select("id", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)], *added[1:])
