"""A prefix trie of conversations: nodes, their members, and the tokens that sharing their prefixes saves.

A node is a sequence of first turns. Every conversation has a path from the root through one node a turn, and a node is
owned by its smallest member. Whoever owns a node owns all deeper nodes of its own path (their members are members of
this one too), so a conversation owns a suffix of its path, and each node of a subtree is owned by a member of its top.
Sums over a subtree are then sums over the top's members of what each has from there on:

* its tokens (an occurrence each) without those of nodes it owns: what the subtree saves;
* one where it owns a childless node, which is always the end of its path: the leaves.

So no node is ever joined with its descendants. The paths are one row a turn; the nodes' owners come from an aggregate
that is combined before the shuffle, go back to the rows by ``join_by_key`` (the root and common openings hold a large
share of the rows), windows along each path mark what is owned and add up from its end, and one group-by by node ends it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm._skew import join_by_key
from gaugeline.llm._store import Scratch, partitions

#: Bytes of a node's digest, and the root's.
WIDTH = 16
ROOT = bytes(WIDTH)
#: Conversation ids of one block: so many ids of conversations that end in one node are put in order at a time.
BLOCK = 4096
#: Rows of a result batch.
BATCH = 8192


def _step(node: bytes, role: bytes, text: bytes) -> bytes:
    """The digest of a node's child by a turn."""
    return hashlib.blake2b(text, digest_size=WIDTH, key=node, salt=hashlib.blake2b(role, digest_size=16).digest()).digest()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, str]]:
    """(base, conv_id, role, text) of the rows, in their order."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _shared(rows: Iterator[tuple], kinds: int) -> Iterator[tuple[int, str | None, str | None]]:
    """(conv_id, role, text) of conversations whose first turns are those of their base; a turnless start row for each.

    A conversation takes ``crc32(its decimal id) mod kinds`` turns from its base, which comes first among those that
    share it; it is what is held, kinds - 1 turns of it at most.
    """
    base = conv = None
    head: list[tuple] = []
    skip = seen = 0
    for b, c, role, text in rows:
        if b != base:
            base, conv, head = b, None, []
        if c != conv:
            conv, seen = c, 0
            skip = zlib.crc32(str(c).encode()) % kinds
            yield c, None, None
            if c != b:
                for turn in head[:skip]:
                    yield c, *turn
        if c == b and len(head) < kinds - 1:
            head.append((role, text))
        if c == b or seen >= skip:
            yield c, role, text
        seen += 1


def _plain(rows: Iterator[tuple]) -> Iterator[tuple[int, str | None, str | None]]:
    """(conv_id, role, text), a turnless start row for each conversation."""
    conv = None
    for _, c, role, text in rows:
        if c != conv:
            conv = c
            yield c, None, None
        yield c, role, text


def _paths(turns: DataFrame, share: tuple[int, int] | None) -> DataFrame:
    """(conv_id, depth, node, words, last) of every node of every path, the root included."""
    conv = F.col("conv_id").cast("long")
    rows = turns.where("conv_id is not null").select(
        (conv - conv % F.lit(share[0]) if share else conv).alias("base"), conv.alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").alias("turn"),
    )
    # the base is the member of its group that is nearest to zero
    order = ["base", F.abs("conv_id"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition(partitions(turns.sparkSession), "base").sortWithinPartitions(*order)
    names, kinds = ["conv_id", "depth", "node", "words", "last"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None
        found = _turns(batches)
        for c, role, text in _shared(found, share[1]) if share else _plain(found):
            if held is not None:
                out.append((*held, role is None))
            if role is None:
                held = (c, 0, ROOT, 0)
            else:
                body = text.encode()
                held = (c, held[1] + 1, _step(held[2], role.encode(), body), len(body.split()))
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if held is not None:
            out.append((*held, True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.select("base", "conv_id", "role", "text").mapInArrow(run, "conv_id long, depth int, node binary, words long, last boolean")


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ascending decimal ids, joined by commas, of the conversations that end in a node.

    SHA-256 is a chain, so a node's ids pass through one task in order, but as text of up to BLOCK ids a row that was put
    in order before; none of it is held.
    """
    block = F.floor(F.col("conv_id") / F.lit(BLOCK))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = paths.where("last").groupBy("node", block.alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, str]] = []
        node = state = None
        for batch in batches:
            for v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = v, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])
                out = []
        if state is not None:
            out.append((node, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])

    dealt = blocks.repartition(partitions(paths.sparkSession), "node").sortWithinPartitions("node", "block")
    return dealt.select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, turns: DataFrame, share: tuple[int, int] | None = None) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv_id, turn, role, text).

    Columns: node (its digest), conv_id (smallest member), depth, parent_conv_id (its parent's conv_id, null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. n_leaves counts the childless nodes of a node's subtree, itself
    included; saved_tokens adds up (n_convs - 1) times the words of the last text over the subtree; ends_sha256 is the
    digest of the ids of the conversations that end in the node.

    share (span, kinds): each conversation c first takes h turns of conversation c - c % span, h being its id's crc32 modulo
    kinds, in place of its own first h; all if that one has fewer, none if there is none. One that is left without turns is
    a member of the root.

    Rows are ordered by turn (null first), then role and text; each is a turn, also equal ones. A null role or text is
    empty, rows without conv_id are dropped. A conversation streams through one task, whatever its length; texts are read
    whole. An empty table has no node. Other columns are not read.
    """
    scratch = Scratch(spark, "trie")
    paths = scratch.keep(_paths(turns, share), "paths")
    owners = paths.groupBy("node").agg(F.count("*").alias("members"), F.min("conv_id").alias("owner"), (F.count("*") == F.sum(F.col("last").cast("long"))).alias("childless"))
    marked = join_by_key(paths, scratch.keep(owners, "owners"), ["node"], paths.count(), F.col("conv_id"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = F.col("owner") == F.col("conv_id")
    along = marked.select(
        "node", "conv_id", "depth",
        F.lead("owner").over(up).alias("parent"),
        F.coalesce(F.lag(owned).over(up), F.lit(False)).alias("owns_next"),
        F.sum(F.when(owned, 0).otherwise(F.col("words"))).over(so_far).alias("saved"),
        F.sum((owned & F.col("last") & F.col("childless")).cast("long")).over(so_far).alias("leaf"),
    )
    nodes = along.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(F.col("owns_next").cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(_ends(paths), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
