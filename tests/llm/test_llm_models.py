import math
import zlib

import numpy as np
import pytest

from gaugeline.llm import langid, quality
from gaugeline.llm._split import bucket

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.where(langid.learned_rows()))


def test_language_on_held_out_rows(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in langid.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_rows(spark, model):
    texts = [None, "", "123 !!", "東京都は日本の首都であり人口が最も多い都市であると言われているのでとても大きいです。" * 2, "the", "É"]
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(texts)] + [(None, "the", "en", 0.0), (4, "the", "en", 1.0)], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert [by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in range(3)] == [True] * 3
    assert by[3].lang_pred in model.languages and by[3].rejected
    assert by[4].lang_pred in model.languages and not by[4].rejected and by[5].lang_pred in model.languages
    # letters without a language, in a script and of a length that the model knows
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n)) + " xq" * (n // 10) for n in (200, 500, 3000)]
    assert all(r.rejected for r in langid.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect())
    assert langid.identify(df.limit(0), model).count() == 0
    assert langid.fit(df.limit(0), lang_col="lang_pred") is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(4)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(26):
        # each language has its own five letters; the last ones are the rarest, one has no ids
        own = [letters[(k * 3 + j * (k % 4 + 1)) % 26] for j in range(5)]
        rows += [(None if k == 25 else len(rows) + i, " ".join("".join(rng.choice(own, 4)) for _ in range(30)), f"l{k:02d}") for i in range(40 - k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == [f"l{k:02d}" for k in range(26)]
    got = langid.identify(df, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang >= "l20"]) > 0.9


def test_languages_are_learned_from_every_text(spark):
    """No text is left out of weights, centroids or limits: 3000 texts, of which few have letters of their own."""
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as lang", "if(id % 300 < 2, repeat('zqxj ', 30), if(id % 2 = 0, repeat('lorem ipsum ', 12), repeat('dolor amet ', 13))) as text")
    model, again = langid.fit(df), langid.fit(df.repartition(7))
    assert all(np.array_equal(getattr(model, k), getattr(again, k)) for k in ("idf", "centroids", "least"))
    counts = np.zeros(langid.DIM)
    for r in df.collect():
        raw = r.text.encode()
        counts[langid._counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] > 0] += 1
    assert np.allclose(model.idf, np.log(3001 / (1 + counts)) + 0.01, rtol=1e-5)
    # one text in 150 is below the hundredth that limits are set at
    assert langid._limits({8: np.bincount([100] * 9 + [4096] * 991, minlength=langid.STEPS + 1)})[8] == pytest.approx(langid.REJECT * 0.5)


def test_many_languages_share_the_sample(spark):
    from gaugeline.llm._split import sample_every

    df = spark.range(8000).selectExpr("if(id % 2 = 0, id, null) as key", "cast(id % 4 as string) as lang", "concat('t', id) as text").union(spark.sql("select 1L, 'rare', 'x'"))
    for each, most, few, want in ((100, 10_000, 10, 100), (100, 200, 10, 40), (100, 20, 10, 10)):
        got = {r.lang: r["count"] for r in sample_every(df, "lang", "key", "text", each, most, few).groupBy("lang").count().collect()}
        assert got.pop("rare") == 1 and len(got) == 4 and all(want / 4 < n < want * 2.5 for n in got.values())


def test_an_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("lang <> 'es'"))
    rows = langid.identify(docs, model).where("length(text) >= 200").collect()
    assert np.mean([r.rejected for r in rows if r.lang == "es"]) > 0.9
    assert np.mean([r.rejected for r in rows if r.lang != "es"]) < 0.01


def brute_language(text, model):
    """The vector of one text, byte by byte, and its cosine with each centroid."""
    raw = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    fold = []
    for i, b in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b |= 0x20
        fold.append(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32)
    counts = dict.fromkeys(range(langid.DIM), 0)
    for i in range(len(fold) - 2):
        if (fold[i], fold[i + 1]) == (32, 32):
            continue
        counts[((fold[i] << 16 | fold[i + 1] << 8 | fold[i + 2]) * 0x9E3779B1 % 2**32) >> 20] += 1
        counts[((fold[i] << 8 | fold[i + 1]) * 0x85EBCA77 % 2**32) >> 20] += 1
    vec = [math.log1p(n) * float(model.idf[k]) for k, n in counts.items()]
    norm = math.sqrt(sum(x * x for x in vec)) or 1.0
    cos = [sum(x * float(y) for x, y in zip(vec, c) if x) / norm for c in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.languages[model.owner[best]], cos[best]


def test_language_against_brute_force(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(docs, model).orderBy("doc_id").limit(80).collect()
    for r in rows:
        lang, score = brute_language(r.text, model)
        assert r.score == pytest.approx(max(0.0, score), abs=1e-5), r.doc_id
        assert r.lang_pred == lang


def test_long_texts_and_repeated_rows(spark, model, net):
    long = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de' and length(text) > 800").orderBy("doc_id").first().text * 1000
    df = spark.createDataFrame([(1, long), (1, long), (2, "a"), (2, "a"), (None, "a")], "doc_id long, text string")
    got = langid.identify(df, model).collect()
    assert not any(r.rejected for r in got)
    assert all(len({r.lang_pred for r in got if r.text == t}) == 1 and np.ptp([r.score for r in got if r.text == t]) < 1e-6 for t in (long, "a"))
    scored = quality.score(df, net).collect()
    assert all(np.ptp([r.score for r in scored if r.text == t]) < 1e-6 for t in (long, "a"))


def test_language_counts_stay_inside_documents():
    data = np.frombuffer("abcÉté".encode() + b"abc", dtype=np.uint8)
    at = np.array([0, len(data) - 3, len(data)])
    both = langid._counts(data, at)
    assert (both[1] == langid._counts(data[at[1] :], np.array([0, 3]))[0]).all()
    low = np.frombuffer("abcété".encode(), dtype=np.uint8)
    assert (both[0] == langid._counts(low, np.array([0, len(low)]))[0]).all()


@pytest.fixture(scope="module")
def net(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return quality.fit(docs, labels.where(bucket("doc_id", 5) != 0))


def test_quality_on_held_out_rows(spark, net):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r for r in quality.score(docs, net).join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_does_not_depend_on_batches(net):
    texts = [b"", b"ab", b"abcdefghijklmnop", b"Hent Hent Hent Hent Hent Hent", b"word&&& other%%% " * 900]
    alone = [quality.score_chunk(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = quality.score_chunk(net, np.frombuffer(b"".join(texts), np.uint8), at)
    assert together == pytest.approx(alone, abs=1e-6)


def test_windows_cover_everything():
    at = np.array([0, 0, 5, 12, 13000])
    start, _, by = quality._windows(at)
    for i in range(4):
        mine, size = start[by[i] : by[i + 1]], at[i + 1] - at[i]
        assert mine[0] == at[i] and (size < quality.WIDTH or mine[-1] + quality.WIDTH == at[i + 1])
        assert (np.diff(mine) <= quality.STRIDE).all()
    lo, hi, off = quality._spans(by)
    for i in range(4):
        a, b = lo[off[i] : off[i + 1]], hi[off[i] : off[i + 1]]
        assert a[0] == by[i] and b[-1] == by[i + 1] and (a[1:] <= b[:-1]).all() and (b > a).all()


def test_quality_rows(spark, net):
    df = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "x", 9.0)], "doc_id long, text string, score double")
    rows = quality.score(df, net).collect()
    assert len(rows) == 3 and rows[0].score == rows[1].score
    assert quality.score(df.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(df, labels) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}


def brute_quality(net, raw):
    """A forward pass window by window, each byte's symbol looked up alone."""
    sym = []
    for i, b in enumerate(raw):
        seen = len(raw) >= 4 and any(raw[i - 3 : i + 1] == raw[i - 3 - lag : i + 1 - lag] for lag in range(3, 25) if i - 3 - lag >= 0)
        # the first bytes of a text have too little before them to repeat it at every distance
        sym.append(b + 256 if seen and i >= 27 else b)
    last = max(0, len(raw) - quality.WIDTH)
    starts = sorted({*range(0, last, quality.STRIDE), last})
    act = []
    for a in starts:
        window = [sym[k] if k < len(raw) else 0 for k in range(a, a + quality.WIDTH)]
        x = np.concatenate([net.table[w] for w in window]).astype(np.float64)
        act.append(np.maximum(x @ net.filters.astype(np.float64) + net.bias, 0))
    chunks = []
    for lo in range(0, len(act), quality.HOP_WINDOWS):
        chunks.append(np.max(act[lo : lo + quality.CHUNK_WINDOWS], axis=0))
        if lo + quality.CHUNK_WINDOWS >= len(act):
            break
    z = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.out + net.out_bias + net.shift
    return 1 / (1 + math.exp(-z))


def test_quality_against_brute_force(spark, net):
    rows = quality.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), net).orderBy("doc_id").limit(40).collect()
    for r in rows:
        assert r.score == pytest.approx(brute_quality(net, (r.text or "").encode()), abs=1e-4), r.doc_id


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(k, ("good words here " if k % 2 else "bad%%% &&&& ") * (9000 if k < 4 else 3)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    for budget in (quality.SAMPLE_BYTES, 300_000):
        net = quality.fit(docs, labels, epochs=3, sample_bytes=budget)
        assert np.mean([(r.score > 0.5) == bool(r.doc_id % 2) for r in quality.score(docs, net).collect()]) > 0.9
