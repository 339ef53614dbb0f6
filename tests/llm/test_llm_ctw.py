import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import ctw


def steps(x):
    b = b"\0" * ctw.DEPTH + x + b"\xff"
    for j in range(ctw.DEPTH, len(b)):
        context = b[j - ctw.DEPTH : j][::-1]
        for k in range(8):
            yield context, 1 << k | b[j] >> (8 - k), b[j] >> (7 - k) & 1


def kt(c):
    return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)


def brute(train):
    count = [collections.defaultdict(lambda: [0, 0]) for _ in range(ctw.DEPTH + 1)]
    for x in train:
        for context, node, bit in steps(x):
            for d in range(ctw.DEPTH + 1):
                count[d][context[:d], node][bit] += 1
    weighted = [{} for _ in count]
    for d in range(ctw.DEPTH, -1, -1):
        below = collections.Counter()
        if d < ctw.DEPTH:
            for (c, node), v in weighted[d + 1].items():
                below[c[:d], node] += v
        for key, c in count[d].items():
            weighted[d][key] = kt(c) if d == ctw.DEPTH else float(np.logaddexp(kt(c), below[key])) + math.log(0.5)

    def score(x):
        total = 0.0
        for context, node, bit in steps(x):
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                c = count[d].get((context[:d], node))
                if c:
                    w = 1 if d == ctw.DEPTH else math.exp(kt(c) + math.log(0.5) - weighted[d][context[:d], node])
                    p = w * (c[1] + 0.5) / (sum(c) + 1) + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        return total

    return score


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", None, "", "zebra é quux the", "THE CAT", "the cat sat on the mat", "\x00\x00 \t"]


@pytest.mark.parametrize("held", [10**6, 5])
def test_scores(spark, held, monkeypatch):
    monkeypatch.setattr(ctw, "BUILD_BLOCK", held // 3)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_bytes int")
    got = {r.id: r for r in ctw.score(spark, df, F.col("doc_id") < 5, held=held, held_words=held).collect()}
    score = brute([(t or "").encode() for t in TEXTS[:5]])
    words = [[*(t or "").encode().lower().split(), None] for t in TEXTS]
    words[8] = [b"\x00\x00", None]
    c = collections.Counter(w for x in words[:5] for w in x)
    n = sum(c.values())
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert r.score == pytest.approx(score((t or "").encode()), abs=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words[i]), abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words[i]), sum(c[w] > 0 for w in words[i]), n, i >= 5)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len((t or "").encode()) + 1))


def test_probabilities_sum_to_one():
    texts = [b"abracadabra", b"abc abc"]
    codes = [ctw.gram_codes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    code, n = ctw._reduced(np.concatenate(codes))
    for context in (code[3] >> np.uint64(8), np.uint64(0xFFFFFF)):
        every = (np.full(256, context, dtype=np.uint64) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        extra = np.setdiff1d(every, code)
        all_codes, all_n = np.concatenate([code, extra]), np.concatenate([n, np.zeros(len(extra), n.dtype)])
        order = np.argsort(all_codes)
        p, _ = ctw.build(all_codes[order], all_n[order])
        prob = 10 ** ctw.log10_of(p, all_codes[order] & np.uint64(255))
        assert prob[np.isin(all_codes[order], every)].sum() == pytest.approx(1)


def test_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = ctw.score(spark, df, F.col("doc_id") == 1).collect()
    assert len(rows) == 3 and len({round(r.score, 9) for r in rows}) == 1 and [r.held_out for r in rows].count(True) == 1
    none = ctw.score(spark, df, F.lit(False)).first()
    assert none.score == pytest.approx(-8 * 4 * math.log10(2)) and none.train_tokens == 0 and none.n_known == 0
    assert ctw.score(spark, df.limit(0), F.lit(True)).count() == 0


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    t = ctw.Table(keys, np.arange(len(keys), dtype=float))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(t.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)]).all()
    assert np.isnan(ctw.Table(keys[:0], np.zeros(0)).get(keys)).all()


def test_a_table_takes_few_bytes_a_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 70_000, dtype=np.uint64))
    t = ctw.Table(keys, np.arange(len(keys), dtype=float))
    assert sum(x.nbytes for x in vars(t).values() if isinstance(x, np.ndarray)) < 25 * len(keys)
    assert (t.get(keys[::-1]) == np.arange(len(keys))[::-1]).all()


class Captured:
    """Stands for a DataFrame and keeps the function that tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def counting(texts, learn):
    """What one task hands on, batch by batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(learn)], ["text", "learn"])
    return ctw._counts(Captured()).run(iter([batch]))


@pytest.mark.parametrize(("block", "held"), [(10**6, 10**6), (40, 10**6), (40, 60)])
def test_counts_in_small_blocks(block, held, monkeypatch):
    monkeypatch.setattr(ctw, "COUNT_BLOCK", block)
    monkeypatch.setattr(ctw, "COUNT_HELD", held)
    monkeypatch.setattr(ctw, "TEXT_BLOCK", 30)
    texts, learn = [t or "" for t in TEXTS] * 3, [i % 9 < 5 for i in range(27)]
    want, got = collections.Counter(), collections.Counter()
    for t, k in zip(texts, learn, strict=True):
        data, at = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        for code in ctw.gram_codes(data, at)[0].tolist():
            want[ctw.GRAM, code] += k
        for code in ctw.word_hashes(data, at)[0].tolist():
            if k:
                want[ctw.WORD, code] += 1
    rows = [r for b in counting(texts, learn) for r in b.to_pylist()]
    for r in rows:
        got[r["kind"], r["code"] % 2**64] += r["n"]
    assert dict(got) == dict(want) and (len(rows) == len(want)) == (held > 60)


def test_a_counting_task_holds_little():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"etaoinshrdlu ", np.uint8)
    texts = [bytes(letters[rng.integers(0, len(letters), 2000)]).decode() for _ in range(4000)]
    tracemalloc.start()
    assert sum(b.num_rows for b in counting(texts, [True] * len(texts))) > 10**6
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 145e6


def test_beats_the_base_on_held_out_text(spark):
    from gaugeline.llm._split import bucket

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ctw.score(spark, docs, bucket("doc_id", 10) != 0).where("held_out").collect()
    assert all(zlib.crc32(str(r.id).encode()) % 10 == 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_query_counts_rows_without_an_id_as_not_held_out(spark, tmp_path):
    from gaugeline.llm.queries import op7_context_tree_scoring

    rows = [(None, "a b"), *((i, f"a b {i}") for i in range(40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.held_out for r in op7_context_tree_scoring(spark, str(tmp_path)).collect()}
    import zlib

    assert got == {None: False} | {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(40)}
