"""SentencePiece encoding against the library: ids, source spans, decoded texts, and the normaliser by itself."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from gaugeline.llm._text import string_buffers
from gaugeline.llm.pieces import CharMap, Model, _fields, encode, normalise

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a ", "Hello  wörld", "line\n\n\ttab\r\n", "▁", " ▁ ▁▁x", "😀 emoji 👩‍👩‍👧", "日本語のテキスト", "\x00nul", "<s> </s> <unk> <0x0A>", "ﬁ Å ½",
    "é" * 50, "  　wide", "x" * 5000, "a b " * 3000, "\U0010ffff", "é",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def noise(seed, n):
    rng = random.Random(seed)
    marks = [" ", "  ", "\n", "\t", "ab", "The", "é", "ü", "日", "😀", "ﬁ", "Ａ", "①", "́", "​", "ｶﾞ", "▁", "\x7f", "½", "　", "Ⅷ", "x"]
    return ["".join(rng.choices(marks, k=rng.randrange(0, 30))) for _ in range(n)]


def numbers(blob):
    return np.frombuffer(bytes(blob), "<u4").tolist()


def test_ids_spans_and_texts_are_those_of_the_library(spark, library):
    texts = TEXTS + noise(1, 300)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in encode(rows, FILE).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = out[i]
        assert numbers(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids)
        begins, ends = numbers(r["begins"]), numbers(r["ends"])
        want = [(p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces]
        assert list(zip(begins, ends))[1:-1] == want
        # the spans follow each other and cover the text
        size = len((text or "").encode())
        assert begins[0] == ends[0] == 0 and begins[-1] == ends[-1] == size
        assert ends[:-1] == begins[1:]


def test_without_begin_and_end(spark, library):
    rows = spark.createDataFrame([(1, "two words"), (2, "")], "doc_id long, text string")
    out = {r["doc_id"]: numbers(r["ids"]) for r in encode(rows, FILE, ends=False).collect()}
    assert out == {1: library.encode("two words"), 2: []}


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = spark.createDataFrame([(None, None, 1), (None, "x", 2), (5, "x", 3), (5, "x", 3)], "doc_id long, text string, source int")
    out = encode(rows, FILE)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "begins", "ends", "decoded"]
    assert sorted((r["doc_id"] or 0, r["source"], r["decoded"]) for r in out.collect()) == [(0, 1, ""), (0, 2, "x"), (5, 3, "x"), (5, 3, "x")]
    assert encode(rows.limit(0), FILE).count() == 0
    with pytest.raises(ValueError, match="ids"):
        encode(rows.withColumnRenamed("source", "IDs"), FILE)


def test_very_long_text(spark, library):
    text = "lorem ipsum  dolor " * 120_000
    (r,) = encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), FILE).collect()
    assert r["n_tokens"] == len(library.encode(text)) + 2 and r["decoded"] == text
    assert max(numbers(r["ends"])) == len(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_normaliser_is_that_of_the_library(rule, collapse, prefix, escape):
    peer = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=collapse, add_dummy_prefix=prefix, escape_whitespaces=escape)
    spec = next(dict(_fields(v)) for k, v in _fields(peer.serialized_model_proto()) if k == 3)
    model = Model(b"", CharMap.read(spec.get(2, b"")), prefix, collapse, escape, np.zeros(0, np.int64))
    texts = [t or "" for t in TEXTS] + noise(7, 400)
    data, at = string_buffers(pa.array(texts))
    norm, by, source, stop = normalise(model, data, at)
    for i, text in enumerate(texts):
        want, place = peer.normalize(text, with_offsets=True)
        body = norm[by[i] : by[i + 1]]
        assert body.tobytes().decode() == want, repr(text)
        # the library counts in characters here
        chars = np.flatnonzero((np.append(body, 0) & 0xC0) != 0x80)
        ours = np.append(source[by[i] : by[i + 1]], stop[i])[chars] - at[i]
        raw = text.encode()
        if want:
            assert [len(raw[:k].decode()) for k in ours.tolist()] == list(place), repr(text)


def test_models_that_cannot_spell_every_byte_are_refused():
    with open(FILE, "rb") as file:
        blob = file.read()
    # a later trainer field overrides an earlier one: no byte fallback
    with pytest.raises(ValueError, match="byte fallback"):
        Model.read(blob + bytes([0x12, 3, 0x98, 2, 0]))
