"""Importance resampling against a version with one dictionary for all."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import resample as module
from gaugeline.llm._text import string_buffers
from gaugeline.llm.resample import feature_crcs, resample

SCHEMA = "doc_id long, text string"


def features(text, runs=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, runs=2, buckets=10000, seed=7, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, runs)[1]))
    for text in target:
        t.update(map(bucket, features(text, runs)[1]))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, have = features(text, runs)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, have)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(words), len(have), weight, score))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = Counter()
    drawn = able[: percent * len(able) // 100]
    out = [(*r, k) for k, r in enumerate(drawn, 1)]
    ranks.update(drawn)
    for r in rows:
        if ranks[r] > 0:
            ranks[r] -= 1
        else:
            out.append((*r, None))
    return sorted(out, key=repr)


def got(spark, docs, target, **how):
    table = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample(spark, spark.createDataFrame(docs, SCHEMA), table, **how)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "x" * 60, "y" * 49, "z" * 48, "日本", "A1"]
    text = lambda: rng.choice([" ", ", ", "\n\0"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 21, 60])))
    return [(i, text()) for i in range(n)], [text() for _ in range(9)]


@pytest.mark.parametrize("how", [{}, {"buckets": 3, "percent": 60, "least": 5}, {"runs": 3, "seed": 1}, {"runs": 1, "percent": 100, "least": 0}, {"percent": 0}])
def test_against_brute_force(spark, how):
    docs, target = corpus(len(str(how)))
    named = {"least_words" if k == "least" else k: v for k, v in how.items()}
    assert got(spark, docs, target, **named) == brute(docs, target, **how)


def test_ties_are_cut_by_id(spark, monkeypatch):
    # without noise, equal texts tie
    monkeypatch.setattr(module, "gumbel", lambda *_: module.F.lit(0).cast("long"))
    docs = [(i, "same words " * 12) for i in range(40)] + [(100, "few")]
    ranks = {r[0]: r[5] for r in got(spark, docs, ["other"])}
    assert ranks == {i: i + 1 if i < 10 else None for i in [*range(40), 100]}


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    docs = [(None, "a b " * 15), (None, None), (3, None), (4, ""), (5, ".,;"), (6, "a b " * 15), (6, "a b " * 15), (7, "c d " * 30)]
    assert got(spark, docs, ["a b", None], percent=70) == brute(docs, ["a b", None], percent=70)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], ["a"]) == []
    wide = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA + ", score int, n_words string, rank int")
    out = resample(spark, wide, wide.limit(0))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, [])


def test_very_long_texts(spark):
    docs = [(1, "lorem ipsum " * 300_000), (2, "x" * 2_000_000), (3, "a b c d " * 5)]
    assert got(spark, docs, ["lorem"], percent=100) == brute(docs, ["lorem"], percent=100)


def test_feature_crcs_do_not_cross_documents():
    texts = ["", "Ab cd", "e", "", "q" * 200 + " r", " ", "s " + "t" * 49, "é1"]
    crcs, doc, n_words = feature_crcs(*string_buffers(pa.array(texts)), runs=3)
    for i, text in enumerate(texts):
        words, have = features(text, 3)
        assert n_words[i] == len(words)
        assert sorted(crcs[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in have)
    assert feature_crcs(np.zeros(0, np.uint8), np.zeros(2, np.int64), 2)[0].size == 0
