"""Chat formatting: conversations rebuilt from event logs and rendered with reversible escapes.

A log holds events (conversation, sequence, kind, message, role, text):

* ``message`` starts a message (or sets it anew), ``edit`` replaces its text;
* ``delta`` appends to it;
* ``regenerate`` drops its text and every later message that was started before the regeneration; deltas follow.

A message is its last starting event's text and all deltas after that event, in sequence. A log is dealt by conversation
and sorted by message and sequence, the only shuffle there is, and folded as it streams by: what is held is one message
and the time of the last regeneration so far, however long the conversation. Rendering and digests follow in that order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._store import partitions

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Reversible: ``<``, any backslashes and ``|`` get one backslash more, so no control string stands in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """As ``escape``, and a role stays in one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


#: Code points of a delta in which turns are streamed.
DELTA = 1000


def _folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of events that stream by message, each message's in sequence.

    A regeneration of an earlier message drops those that were started before it, so the latest one so far decides.
    """
    message = events.schema["message"].dataType
    kind = T.StructType([events.schema["conv_id"], T.StructField("message", message), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        done: list[tuple] = []
        conv = name = role = born = redone = latest = None
        open_ = False
        parts: list[str] = []

        def close() -> None:
            nonlocal latest
            if open_ and (latest is None or born >= latest):
                done.append((conv, name, role, "".join(parts)))
            if redone is not None:
                latest = redone if latest is None else max(latest, redone)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], kind.names)
            done.clear()
            return out

        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string()]
            for c, m, seq, what, who, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not open_ or c != conv or m != name:
                    close()
                    if not open_ or c != conv:
                        latest = None
                    conv, name, role, born, redone, open_, parts = c, m, "", seq, None, True, []
                if what == "delta":
                    parts.append(text)
                else:
                    parts = [] if what == "regenerate" else [text]
                    if what == "regenerate":
                        redone = seq
                role = who or role
            if len(done) >= 5000:
                yield flush()
        close()
        if done:
            yield flush()

    return events.select("conv_id", "message", "seq", "kind", "role", "text").mapInArrow(run, kind)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text), in order by task.

    ``message`` is a message's place in its conversation. Null kinds count as ``message``, null texts as empty; ties
    in seq are ordered by kind, role and text, and exact repeats of an event count each. A message's role is the last
    one named. Rows without conversation or message are dropped, an empty log stays empty, further columns are not read.
    """
    rows = events.where("conv_id is not null and message is not null").select(
        "conv_id", "message", F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return _folded(rows.repartition(partitions(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text"))


def render(messages: DataFrame) -> DataFrame:
    """Adds ``formatted`` and its loss mask, as the trained text's place in code points [loss_start, loss_end), to each message.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; role and text are escaped. The mask covers assistant texts.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    trained = F.col("role") == "assistant"
    return messages.withColumns({
        "formatted": F.concat(head, body, F.lit(END + "\n")),
        "loss_start": F.when(trained, F.length(head)),
        "loss_end": F.when(trained, F.length(head) + F.length(body)),
    })


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    out = []
    for turn in formatted.split(START)[1:]:
        head, _, rest = turn.partition("\n")
        out.append((unescape_role(head), unescape(rest[: rest.rindex(END)])))
    return out


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's rows must follow each other in one task, as ``fold_events`` leaves them. The hashes are chains over a
    conversation's turns, so they are fed turn by turn, and no more than one batch is in memory however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        rows: list[tuple] = []

        def close() -> None:
            if state is not None:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for c, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    trained = unescape(formatted[a:b])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(formatted)
            if len(rows) >= 5000:
                yield flush()
        close()
        if rows:
            yield flush()

    return rendered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """Rendered turns (conv_id, turn, role, text, formatted, loss_start, loss_end) of a table of turns (conv_id, turn, role, text).

    Each row is a message of its own, logged as it would be streamed: its first ``delta`` code points start it, the rest
    comes in deltas. Rows of one conversation and turn, also equal ones, are separate turns, ordered by role and text. A
    null turn comes first, a null role or text is empty, rows without a conversation are dropped; very long texts are
    whole turns, and an empty table stays empty. Other columns are not read.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # numbered after the sort, so that messages of a task come in their order
    dealt = dealt.withColumn("message", F.struct("turn", F.monotonically_increasing_id().alias("row")))
    last = F.greatest(F.floor((F.length("text") - 1) / delta), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * delta + 1, F.lit(delta)))
    events = dealt.select("conv_id", "message", "role", F.posexplode(F.when(F.length("text") <= delta, F.array("text")).otherwise(parts)).alias("seq", "part"))
    log = events.select("conv_id", "message", "seq", F.when(F.col("seq") == 0, "message").otherwise("delta").alias("kind"), "role", F.col("part").alias("text"))
    return render(_folded(log).select("conv_id", F.col("message.turn").alias("turn"), "role", "text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """The digests of every conversation of a table of turns, from its rendered form; rows as in ``format_conversations``."""
    return digests(format_conversations(turns))
