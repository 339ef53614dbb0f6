"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

SuperMinHash draws, for each shingle, a random permutation of the signature's slots and one uniform value per
step; slot p_j keeps the least r_j + j. A shingle stops once j passes the largest value its document still
holds, which for long documents is after one or two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm._skew import hot_ends, join_by_key, join_salted
from gaugeline.llm._store import Scratch
from gaugeline.llm._text import U64, chunks, mix64, shingle_hashes, word_hashes
from gaugeline.llm.components import connected_components

#: 36 bands of 5: two sets of similarity 0.8 share no band with probability (1 - 0.8**5)**36 = 6e-7.
BANDS, ROWS = 36, 5
#: Pairs whose signatures agree in less than this share below the threshold are not verified: more than six
#: standard deviations of the estimate at 180 slots.
SLACK = 0.2
#: Slots of the finer signatures that settle what the rounds leave open, and the slack there: four standard
#: deviations of the estimate.
FINE_SLOTS, FINE_SLACK = 1024, 0.05
#: What identifies a set of shingles.
SET_KEY = ["set_a", "set_b", "n_shingles"]
#: Members of a bucket that meet in one task, on either side.
BLOCK = 1024
#: Rounds that test each bucket's members against one member before the rest is tested pair by pair.
STAR_ROUNDS = 4


def _uniform(x: np.ndarray, j: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = U64((j * 0x9E3779B97F4A7C15 + salt) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(x ^ seed) >> U64(11)).astype(np.float64) * 2.0**-53


def superminhash(elements: np.ndarray, by: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots, float64) of the element sets elements[by[i]:by[i+1]]; repeats change nothing.

    An empty set keeps the value ``slots`` in every slot.
    """
    n = len(by) - 1
    out = np.full(n * slots, float(slots))
    doc = np.repeat(np.arange(n), np.diff(by))
    x = elements
    k0 = (_uniform(x, 0, 7) * slots).astype(np.int64)
    np.minimum.at(out, doc * slots + k0, _uniform(x, 0, 11))
    level = out.reshape(n, slots).max(axis=1)
    rest = np.flatnonzero(level[doc] >= 1)
    # documents that need more steps, a bounded number of shingles' permutations at a time
    block = max(1, (1 << 24) // (2 * slots))
    lo = 0
    while lo < len(rest):
        hi = min(len(rest), lo + block)
        if hi < len(rest):  # whole documents, unless one alone is larger
            cut = np.searchsorted(doc[rest], doc[rest[hi]])
            hi = int(cut) if cut > lo else hi
        idx = rest[lo:hi]
        e, d, first = x[idx], doc[idx], k0[idx]
        perm = np.tile(np.arange(slots, dtype=np.int16), (len(idx), 1))
        row = np.arange(len(idx))
        perm[row, 0], perm[row, first] = perm[row, first], perm[row, 0].copy()
        for j in range(1, slots):
            k = j + (_uniform(e, j, 7) * (slots - j)).astype(np.int64)
            slot = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
            np.minimum.at(out, d * slots + slot, _uniform(e, j, 11) + j)
            docs = np.unique(d)
            top = out.reshape(n, slots)[docs].max(axis=1)
            live = np.zeros(n, dtype=bool)
            live[docs[top >= j + 1]] = True
            keep = live[d]
            if not keep.any():
                break
            if keep.mean() < 0.8:
                e, d, perm = e[keep], d[keep], perm[keep]
                row = np.arange(len(e))
        lo = hi
    return out.reshape(n, slots)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, distinct shingles, offsets) in chunks."""
    for lo, hi, data, at in chunks(column):
        sh, by = shingle_hashes(*word_hashes(data, at), size)
        parts = [np.unique(sh[a:b]) for a, b in zip(by[:-1], by[1:], strict=True)]
        yield lo, hi, (np.concatenate(parts) if parts else sh[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, text); id and text_hash identify a text, also where ids are null or repeated."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_hash, n_shingles, set_a, set_b, bands, sketch): two 64-bit hashes of the whole set, a key for each band, a byte for each slot."""
    slots = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, by in _sets(batch.column(2), size):
                sig = superminhash(x, by, slots)
                code = mix64(sig.view(U64))
                keys = np.zeros((hi - lo, bands), dtype=U64)
                for r in range(rows):
                    keys = mix64(keys + code[:, r::rows] + U64(r + 1))
                keys = mix64(keys ^ np.arange(1, bands + 1, dtype=U64))
                n = np.diff(by)
                full = n > 0
                sums = np.zeros((2, hi - lo), dtype=U64)
                if len(x):
                    at = by[:-1][full]
                    sums[0][full] = np.add.reduceat(mix64(x ^ U64(0xA5A5A5A5A5A5A5A5)), at)
                    sums[1][full] = np.add.reduceat(mix64(x + U64(0x1234567)), at)
                sketch = (code >> U64(13)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return _identified(docs, id_col, text_col).mapInArrow(run, "id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


def _with_both(pairs: DataFrame, table: DataFrame, value: str, hot: list[int] | None) -> DataFrame:
    """Pairs (a, b) with the value of either end; pairs of a document that has very many (a bucket's centre) are dealt out."""
    for end, other in (("a", "b"), ("b", "a")):
        pairs = join_salted(pairs, table.select(F.col("id").alias(end), F.col(value).alias(f"of_{end}")), end, hot, F.col(other))
    return pairs.select("a", "b", "of_a", "of_b")


def _promising(pairs: DataFrame, sketch: DataFrame, least: float, hot: list[int] | None) -> DataFrame:
    """Pairs (a, b) whose sketches agree in at least ``least`` of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return _with_both(pairs, sketch, "sketch", hot).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, hot: list[int] | None) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sets: list[list[np.ndarray]] = []
            for i in (2, 3):
                one: list[np.ndarray] = []
                for _, _, x, by in _sets(batch.column(i), size):
                    one += [x[p:q] for p, q in zip(by[:-1], by[1:], strict=True)]
                sets.append(one)
            for r, (x, y) in enumerate(zip(*sets, strict=True)):
                if len(x) and len(y):
                    both = np.concatenate([x, y])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    keep[r] = 100 * inter >= percent * (len(x) + len(y) - inter)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return _with_both(pairs, texts, "text", hot).mapInArrow(run, "a long, b long")


def _open_pairs(now: DataFrame, texts: DataFrame, first: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose finer signatures come near the threshold.

    In each bucket the members outside its commonest component meet all others of the bucket, in blocks of BLOCK by
    BLOCK members, so neither a bucket nor its pairs lie in one task; only promising pairs are emitted, each in its first common bucket.
    now: (key, id, n, component).
    """
    ranked = now.withColumn("size", F.count("*").over(Window.partitionBy("key", "component")))
    top = ranked.groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("top"), F.max("size").alias("most"), F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi")
    top = top.select("key", "top", F.ceil(F.col("members") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("no"))
    rows = scratch.keep(ranked.select("key", "id", "n", "component").join(top, "key"), "open")
    ids = rows.select("id").distinct()

    def run_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, by in _sets(batch.column(1), size):
                code = (mix64(superminhash(x, by, FINE_SLOTS).view(U64)) >> U64(13)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "fine"])

    fine = scratch.keep(texts.join(ids, "id", "left_semi").mapInArrow(run_fine, "id long, fine binary").join(first.select("id", "bands"), "id"), "fine")
    salt = F.xxhash64("id")
    inner = rows.withColumn("mb", F.pmod(salt, F.col("nb")).cast("int")).withColumn("ob", F.explode(F.expr("sequence(0, no - 1)"))).withColumn("outer", F.lit(False))
    outer = rows.where("component <> top").withColumn("ob", F.pmod(salt, F.col("no")).cast("int")).withColumn("mb", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("outer", F.lit(True))
    cols = ["key", "ob", "mb", "outer", "id", "n", "component", (F.col("component") == F.col("top")).alias("common")]
    both = inner.select(*cols).unionByName(outer.select(*cols)).join(fine, "id")
    least = percent / 100 - FINE_SLACK

    def meet(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        side = rows["outer"]
        if side.all() or not side.any():
            return
        code = rows["fine"]
        m = np.flatnonzero(~side)
        for i in np.flatnonzero(side):
            n, k = rows["n"][i], rows["n"][m]
            fit = (rows["component"][m] != rows["component"][i]) & (100 * np.minimum(n, k) >= percent * np.maximum(n, k))
            fit &= rows["common"][m] | (rows["id"][i] < rows["id"][m])
            at = m[fit]
            if len(at):
                # of the buckets that two share, the first one tests them
                shared = rows["bands"][at] == rows["bands"][i]
                at = at[rows["bands"][i][shared.argmax(axis=1)] == rows["key"][i]]
            if len(at):
                at = at[(code[at] == code[i]).mean(axis=1) >= least]
            if len(at):
                x, y = rows["id"][at], np.full(len(at), rows["id"][i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = {c: batch.column(i).to_numpy(False) for i, c in enumerate(("key", "ob", "mb", "outer", "id", "n", "component", "common"))}
            cell["fine"] = np.frombuffer(b"".join(batch.column(8).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, FINE_SLOTS)
            cell["bands"] = batch.column(9).flatten().to_numpy().reshape(batch.num_rows, -1)
            new = np.flatnonzero((np.diff(cell["key"]) != 0) | (np.diff(cell["ob"]) != 0) | (np.diff(cell["mb"]) != 0)) + 1
            for a, b in zip(np.append(0, new), np.append(new, batch.num_rows), strict=True):
                this = (cell["key"][a], cell["ob"][a], cell["mb"][a])
                if held and this != name:
                    yield from meet({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                    held = []
                name = this
                held.append({c: v[a:b].astype(bool) if c in ("outer", "common") else v[a:b] for c, v in cell.items()})
        if held:
            yield from meet({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    spread = both.repartition("key", "ob", "mb").sortWithinPartitions("key", "ob", "mb")
    return spread.select("key", "ob", "mb", "outer", "id", "n", "component", "common", "fine", "bands").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept, text_hash).

    A document's set holds its distinct runs of ``shingle_words`` words (A-Z lower-cased); fewer words make one
    shingle, none (or a null text) an empty set that is linked with nothing. Documents are linked where
    100 * intersection >= percent * union; component_id is the smallest id reachable over links. ``kept`` marks the
    one document of each component that has this id. text_hash (xxhash64 of the text, null as "") is returned so that
    results can be joined back where ids do not identify rows.

    Every row is a document of its own. A null id never names a component unless all its ids are null, which makes
    component_id null; of rows with one id each text counts, and where several in a component have the smallest id
    one of them is kept. Very long texts are read whole. Other columns of ``docs`` are not read.

    Documents with equal sets form a class first (a hash aggregate, combined before the shuffle), and only one
    of each class goes on. Buckets of a band never emit all their pairs: in each round a member is tested
    against one member of each of its buckets, and members that links already join are not tested again. What
    is left in different components after STAR_ROUNDS then meets within its buckets, block by block, on finer
    signatures, and pairs near the threshold are verified. So a link can only be missed where two sets share no
    band or their signatures mislead by four standard deviations.
    """
    scratch = Scratch(spark, "minhash")
    # rows are told apart by a number that is given once, when the table is written; from here on it is called id
    sig = signatures(docs, id_col, text_col, shingle_words, bands, rows).withColumnRenamed("id", "doc").withColumn("id", F.monotonically_increasing_id())
    sig = scratch.keep(sig, "signatures")
    filled = sig.where("n_shingles > 0")
    # the order of documents: the smallest id, null ids last
    klass = filled.groupBy(*SET_KEY).agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id", "text_hash")).alias("least"), F.count("*").alias("members"))
    klass = scratch.keep(klass.select(*SET_KEY, "members", F.col("least.id").alias("rep"), "least"), "classes")
    first = filled.join(klass.select(F.col("rep").alias("id")), "id", "left_semi")
    first = scratch.keep(first.select("id", "doc", "text_hash", "n_shingles", "bands", "sketch"), "first")
    member = first.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowd = member.withColumn("others", F.count("*").over(Window.partitionBy("key"))).where("others > 1")
    hits = scratch.keep(crowd.select("key", "id", "n"), "hits")
    busy = hits.select("id").distinct()
    # a text is found again by its id and hash; rows that share both have one set, so one of them is a class's first at most
    wanted = first.join(busy, "id", "left_semi").select("id", F.coalesce("doc", F.lit(-(2**62))).alias("by_doc"), F.col("doc").isNull().alias("no_doc"), "text_hash")
    source = _identified(docs, id_col, text_col).select(F.coalesce("id", F.lit(-(2**62))).alias("by_doc"), F.col("id").isNull().alias("no_doc"), "text_hash", "text")
    texts = source.join(wanted.hint("shuffle_hash"), ["by_doc", "no_doc", "text_hash"])
    texts = scratch.keep(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")
    sketch = first.select("id", "sketch")

    labels = busy.select("id", F.col("id").alias("component"))
    tested: DataFrame | None = None
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    for k in range(STAR_ROUNDS + 1):
        now = hits.join(labels, "id") if k else hits.withColumn("component", F.col("id"))
        if k < STAR_ROUNDS:
            # the bucket's centre: its smallest id first, then members in an order that changes by round
            order = F.col("id") if k == 0 else F.struct(F.xxhash64(F.lit(k), F.col("id")), F.col("id"))
            pick = F.min_by(F.struct(F.col("id").alias("c"), F.col("n").alias("m"), F.col("component").alias("cc")), order)
            row = now.withColumn("centre", pick.over(Window.partitionBy("key"))).select("id", "n", "component", "centre.*")
            pairs = row.where((F.col("component") != F.col("cc")) & fits).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        else:
            pairs = _open_pairs(now, texts, first, scratch, shingle_words, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs-{k}")
        if pairs.isEmpty():
            if k < STAR_ROUNDS:
                continue
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        hot = hot_ends(pairs)
        near = _promising(pairs, sketch, percent / 100 - SLACK, hot) if k < STAR_ROUNDS else pairs
        links = scratch.keep(_verified(near, texts, shingle_words, percent, hot), f"links-{k}")
        if links.isEmpty():
            continue
        if k:
            # a bucket's centre is an end of most of its links
            links = join_salted(links, labels.select(F.col("id").alias("a"), F.col("component").alias("src")), "a", hot, F.col("b"))
            links = join_salted(links, labels.select(F.col("id").alias("b"), F.col("component").alias("dst")), "b", hot, F.col("a"))
        merged = connected_components(links.select("src", "dst") if k else links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch, f"cc{k}")
        labels = scratch.keep(labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"labels-{k}")

    grouped = klass.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = scratch.keep(grouped, "grouped")
    best = grouped.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("members"))
    several = best.where("members > 1")
    named = join_by_key(grouped.select(*SET_KEY, "component", "least", F.col("members").alias("copies")), several, ["component"], grouped.count(), F.xxhash64(*SET_KEY), all_rows=True)
    named = named.select(*SET_KEY, F.col("copies").alias("members"), F.coalesce("best", "least").alias("best"))
    named = scratch.keep(named.select(*SET_KEY, "members", F.col("best.doc").alias("component_id"), F.col("best.id").alias("keeper")), "named")
    rows = sig.select("id", "doc", "text_hash", *SET_KEY)
    joined = join_by_key(rows, named, SET_KEY, rows.count(), F.col("id"), all_rows=True)
    alone = F.col("n_shingles") == 0
    out = joined.select(
        F.col("doc").alias("id"), "n_shingles", F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("keeper") == F.col("id"))).alias("kept"), "text_hash"
    )
    scratch.drop("texts", "open", "fine")
    return out
