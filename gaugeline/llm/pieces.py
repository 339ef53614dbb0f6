"""SentencePiece encoding that keeps where every piece came from, and decoding.

A text is first normalised: at each place the longest prefix that the model's compiled character map holds is replaced,
any other character stands for itself; white space is collapsed and marked as the model says. The steps are arrays over
all texts of a batch, and every normalised byte carries the place in the source where what it stands for begins. The
model's merges then run on the normalised text, and the pieces' lengths give each one's place in it, hence its source bytes.

The map is a double array (a trie whose nodes are found by xor): all places of a batch walk it side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._text import chunks

SPACE = "▁".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields: whole numbers, and bytes for all else."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class CharMap:
    """A compiled character map: units of the double array and the replacements, each ended by a zero byte."""

    units: np.ndarray
    replacements: np.ndarray

    @staticmethod
    def read(blob: bytes) -> CharMap | None:
        if not blob:
            return None
        (size,) = struct.unpack_from("<I", blob)
        return CharMap(np.frombuffer(blob, "<u4", size // 4, 4), np.frombuffer(blob, np.uint8, offset=4 + size))

    def longest(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the length of the longest prefix of data[start:stop] in the map (0: none) and its value."""
        units, one = self.units.astype(np.int64), np.int64(1)
        offset = lambda u: (u >> 10) << ((u & (one << 9)) >> 6)
        size, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        who = np.arange(len(starts))
        node = np.full(len(starts), offset(units[0]))
        depth = 0
        while len(who):
            inside = starts[who] + depth < stops[who]
            who, node = who[inside], node[inside]
            byte = data[starts[who] + depth].astype(np.int64)
            node = node ^ byte
            ok = node < len(units)
            who, node, byte = who[ok], node[ok], byte[ok]
            unit = units[node]
            ok = (unit & ((one << 31) | 255)) == byte
            who, node, unit = who[ok], node[ok], unit[ok]
            node = node ^ offset(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            size[who[leaf]] = depth
            value[who[leaf]] = units[node[leaf]] & ((one << 31) - 1)
        return size, value


@dataclass(frozen=True)
class Model:
    """What a model file says about normalising, and the bytes of its pieces. Models whose pieces cannot spell every byte are refused."""

    blob: bytes
    chars: CharMap | None
    dummy_prefix: bool
    collapse: bool
    escape: bool
    widths: np.ndarray

    @staticmethod
    def read(blob: bytes) -> Model:
        widths, spec, suffix, fallback, own = [], {}, False, False, False
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                own |= kind == 4
                widths.append(1 if kind == 6 else 0 if kind in (2, 3) else len(piece[1]))
            elif number == 2:
                trainer = dict(_fields(value))
                suffix, fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
            elif number == 3:
                spec |= dict(_fields(value))
        if suffix or own or not fallback:
            raise ValueError("only models with byte fallback, without own symbols and with spaces in front are read")
        return Model(blob, CharMap.read(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), np.array(widths, np.int64))

    def merger(self):
        """The library's encoder, for texts that are normalised already: a later field of the file overrides an earlier one."""
        import sentencepiece

        plain = bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])
        return sentencepiece.SentencePieceProcessor(model_proto=self.blob + bytes([0x1A, len(plain)]) + plain)

    def decoder(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.blob)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of start[1], and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def normalise(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, n + 1 offsets, source of each byte, source end of each text) of UTF-8 texts in one buffer.

    A byte's source is the place in ``data`` where the replaced prefix or character begins that it stands for. The source
    end lies behind a text's last normalised byte: its end, or where white space begins that was cut off there.
    """
    n_texts = len(at) - 1
    head = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
    begin, width = head[:-1], np.diff(head)
    text = np.searchsorted(at, begin, side="right") - 1
    mapped = np.zeros(len(begin), bool)
    value = np.zeros(len(begin), np.int64)
    if model.chars is not None and len(begin):
        size, value = model.chars.longest(data, begin, at[text + 1])
        mapped = size > 0
        # a prefix of several characters takes those that follow it; what begins inside it is not looked up
        reach, keep = 0, np.ones(len(begin), bool)
        for k in np.flatnonzero(size > width).tolist():
            if begin[k] < reach:
                continue
            reach = int(begin[k] + size[k])
            keep[k + 1 : np.searchsorted(begin, reach)] = False
        width = np.where(mapped, size, width)
        begin, width, text, mapped, value = begin[keep], width[keep], text[keep], mapped[keep], value[keep]
    # what each unit stands for: its own bytes, or a run of the replacements
    source, origin, size = data, begin, width.copy()
    if mapped.any():
        table = model.chars.replacements
        ends = np.flatnonzero(table == 0)
        source = np.concatenate([data, table])
        size[mapped] = ends[np.searchsorted(ends, value[mapped])] - value[mapped]
        origin = np.where(mapped, len(data) + value, begin)
    raw = source[_ranges(origin, size)]
    place = np.repeat(begin, size)
    owner = np.repeat(text, size)
    front, stop = at[:-1].copy(), at[1:].copy()
    if model.collapse and len(raw):
        blank = raw == 32
        first = np.cumsum(size) - size
        # where a text begins: at its first unit that is not a blank by itself
        body = np.flatnonzero((size != 1) | ~blank[np.minimum(first, len(raw) - 1)])[::-1]
        front[text[body]] = begin[body]
        # blanks at the front of a unit go if what stands before the unit is blank, or nothing
        before = np.ones(len(size), bool)
        held = size > 0
        prior = first[held] - 1
        before[held] = (prior < 0) | (owner[np.maximum(prior, 0)] != text[held]) | blank[np.maximum(prior, 0)]
        unit = np.repeat(np.arange(len(size)), size)
        solid = np.concatenate([[0], np.cumsum(~blank)])
        leading = blank & (solid[np.arange(len(raw))] == solid[first[unit]])
        keep = ~(leading & before[unit])
        raw, place, owner, blank = raw[keep], place[keep], owner[keep], blank[keep]
        # and blanks at the end of a text, to which the mark itself counts where blanks are turned into marks
        if model.escape and len(raw) >= len(SPACE):
            mark = np.ones(len(raw) - len(SPACE) + 1, bool)
            for k, byte in enumerate(SPACE):
                mark &= raw[k : len(mark) + k] == byte
            for k in range(len(SPACE)):
                blank[np.flatnonzero(mark) + k] = True
        rank = np.arange(len(raw))
        last = np.full(n_texts, -1)
        last[owner[~blank]] = rank[~blank]
        tail = rank > last[owner]
        cut = np.flatnonzero(tail & np.concatenate([[True], ~tail[:-1] | (owner[1:] != owner[:-1])]))
        stop[owner[cut]] = place[cut]
        raw, place, owner = raw[~tail], place[~tail], owner[~tail]
    count = np.bincount(owner, minlength=n_texts)
    if model.dummy_prefix:
        # a blank in front of every text that has something left, or was not empty where white space stays
        some = np.flatnonzero(count) if model.collapse else np.flatnonzero(np.diff(at))
        where = (np.cumsum(count) - count)[some]
        raw, place, owner = np.insert(raw, where, 32), np.insert(place, where, front[some]), np.insert(owner, where, some)
    if model.escape:
        wide = np.where(raw == 32, len(SPACE), 1)
        first = np.cumsum(wide) - wide
        out = np.repeat(raw, wide)
        for k, byte in enumerate(SPACE):
            out[first[raw == 32] + k] = byte
        raw, place, owner = out, np.repeat(place, wide), np.repeat(owner, wide)
    by = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))])
    return raw, by, place, stop


def _binary(parts: np.ndarray, by: np.ndarray) -> pa.Array:
    """Rows of whole numbers as little-endian bytes."""
    width = parts.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(by) - 1, [None, pa.py_buffer((by * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ends: bool = True) -> DataFrame:
    """docs without their text, with n_tokens, ids, begins, ends (binary) and decoded.

    ``ids`` are a text's tokens as the library gives them for the model, ``ends`` of the call adding begin and end ids;
    ``begins`` and ``ends`` say which bytes of the text each token stands for. All three are little-endian unsigned 32-bit
    numbers side by side, as token files hold them. Begin and end stand for no bytes; where a character is spelt by byte
    tokens the last one has it. ``decoded`` is the library's text for the ids.

    A null text counts as empty, texts are taken whole, rows of any id (also null or repeated) are rows, other columns are
    carried along. The model is read on the driver and goes to the tasks, which cut their batches to texts of about half
    a megabyte at a time.
    """
    with open(model_file, "rb") as file:
        model = Model.read(file.read())
    clash = {c.lower() for c in docs.columns if c != text_col} & {"n_tokens", "ids", "begins", "ends", "decoded"}
    if clash:
        raise ValueError(f"columns named as columns of the result: {sorted(clash)}")
    kept = [c for c in docs.columns if c != text_col]
    place = docs.columns.index(text_col)
    schema = T.StructType([f for f in docs.schema if f.name != text_col]).add("n_tokens", "long").add("ids", "binary").add("begins", "binary").add("ends", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, decoder = model.merger(), model.decoder()
        frame = (np.array([decoder.bos_id()], np.int32), np.array([decoder.eos_id()], np.int32)) if ends else (np.zeros(0, np.int32),) * 2
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(place)):
                norm, by, source, stop = normalise(model, data, at)
                body = norm.tobytes()
                got = merger.encode([body[a:b] for a, b in zip(by[:-1], by[1:], strict=True)], return_type="numpy", num_threads=1)
                ids, begins, stops, decoded = [], [], [], []
                for i, own in enumerate(got):
                    cut = np.concatenate([[0], np.cumsum(model.widths[own])])
                    if cut[-1] != by[i + 1] - by[i]:
                        raise ValueError("pieces do not spell the normalised text")
                    # where each piece begins, and behind the last one where the text ends
                    spot = np.append(source[by[i] : by[i + 1]], stop[i])[cut] - at[i]
                    first, last = frame[0] * 0, frame[1] * 0 + (at[i + 1] - at[i])
                    ids.append(np.concatenate([frame[0], own, frame[1]]))
                    begins.append(np.concatenate([first, spot[:-1], last]))
                    stops.append(np.concatenate([first, spot[1:], last]))
                    decoded.append(decoder.decode(ids[-1].tolist()))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                columns = [_binary(np.concatenate(x).astype("<u4"), offsets) for x in (ids, begins, stops)]
                part = batch.slice(lo, hi - lo)
                rest = [part.column(i) for i in range(part.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(offsets)), *columns, pa.array(decoded, pa.string())], [*kept, "n_tokens", "ids", "begins", "ends", "decoded"])

    return docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
