import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(1)
    codes = [np.repeat(np.arange(4), 15), np.tile(np.repeat(np.arange(5), 3), 4), np.tile(np.arange(3), 20)]
    tokens = rng.integers(1, 1000, 60).astype(float)
    targets = [rng.random(k) for k in (4, 5, 3)]
    weight, error = mixing.rake(tokens, codes, targets)
    assert error < 1e-8
    for code, target in zip(codes, targets):
        got = np.bincount(code, weights=tokens * weight) / tokens.sum()
        assert got == pytest.approx(target / target.sum(), abs=1e-7)


def test_rake_edges():
    weight, _ = mixing.rake(np.array([5.0, 0.0, 5.0]), [np.array([0, 1, 2])], [np.array([0.0, 0.5, 0.5])])
    assert weight[0] == 0 and weight[2] == pytest.approx(2)
    with pytest.raises(ValueError, match="positive target"):
        mixing.rake(np.array([1.0]), [np.array([0])], [np.array([0.0])])


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 0.99999, 1.0])
def test_calibrated_probabilities(share):
    rng = np.random.default_rng(2)
    tokens, weight = rng.integers(1, 100, 50).astype(float), rng.random(50) ** 3
    keep = mixing.calibrate(tokens, weight, share * tokens.sum())
    assert (keep <= 1).all() and (keep * tokens).sum() == pytest.approx(share * tokens.sum())
    free = keep < 1
    if free.any():
        assert np.ptp(keep[free] / weight[free]) < 1e-6


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(spark, docs).collect()
    assert len(rows) == 1000
    tokens = np.array([len(r.text.split()) for r in rows], dtype=float)
    keep = np.array([r.keep_probability for r in rows])
    assert (tokens * keep).sum() / tokens.sum() == pytest.approx(0.7, abs=0.01)
    assert abs(np.mean([r.sampled for r in rows]) - keep.mean()) < 0.05
    again = {r.doc_id: r.sampled for r in mixing.mix(spark, docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.sampled for r in rows}


def test_rows(spark):
    rows = [(1, "a b", "x", "en"), (2, None, None, None), (None, "c", "x", "en"), (2, "", "y", "de"), (3, "d e f", "y", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'t' as topic", "1 as mix_weight", "2 as _s", "3 as _t", "4 as _source", "5 as cell_source", "6 as tokens", "7 as w")
    out = mixing.mix(spark, df, budget=1.0).collect()
    assert len(out) == 5 and all(r.sampled for r in out)
    assert {(r._s, r._t, r._source, r.cell_source, r.tokens, r.w) for r in out} == {(2, 3, 4, 5, 6, 7)}
    again = mixing.mix(spark, df.union(df), budget=0.5).collect()
    assert len(again) == 10 and all(len({r.sampled for r in again if r.doc_id == k and r.text == t}) == 1 for k, t in {(r.doc_id, r.text) for r in again})
    only = mixing.mix(spark, df, targets={"source": {"x": 1.0}}, budget=1.0).collect()
    assert {r.source for r in only if r.sampled} == {"x"}
    assert mixing.mix(spark, df.limit(0)).count() == 0
    blank = mixing.mix(spark, df.where("text is null or text = ''")).collect()
    assert all(r.sampled for r in blank)


def brute_mix(rows, targets, budget):
    """Raking and calibration over whole documents, one at a time, without cells."""
    tokens = np.array([len((r.text or "").encode().split()) for r in rows], dtype=float)
    weight = np.ones(len(rows))
    total = tokens.sum()
    values = {c: [getattr(r, c) or "" for r in rows] for c in mixing.DIMENSIONS}
    shares = {}
    for c, v in values.items():
        names = sorted(set(v))
        raw = [float((targets or {}).get(c, {}).get(n, 0)) if c in (targets or {}) else sum(t for t, x in zip(tokens, v) if x == n) ** mixing.TEMPER for n in names]
        raw = [x if any(t for t, y in zip(tokens, v) if y == n) else 0 for x, n in zip(raw, names)]
        shares[c] = {n: x / sum(raw) for n, x in zip(names, raw)}
    for _ in range(300):
        for c, v in values.items():
            for n, share in shares[c].items():
                mine = np.array([x == n for x in v])
                have = (tokens * weight)[mine].sum()
                weight[mine] *= share * total / have if have else 0
    wanted = np.array([all(shares[c][v[i]] > 0 or tokens[i] == 0 for c, v in values.items()) for i in range(len(rows))])
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * weight)).sum() < budget * total else (low, mid)
    return weight, np.where(tokens == 0, wanted, np.minimum(1, high * weight)), tokens


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.5, "de": 0.3, "fr": 0.2}}])
def test_against_brute_force(spark, targets):
    rows = mixing.mix(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), targets, budget=0.6 if targets is None else 0.3).orderBy("doc_id").collect()
    weight, keep, tokens = brute_mix(rows, targets, 0.6 if targets is None else 0.3)
    for r, w, p, t in zip(rows, weight, keep, tokens):
        if t:
            assert r.mix_weight == pytest.approx(w, rel=1e-6, abs=1e-9) and r.keep_probability == pytest.approx(p, rel=1e-6, abs=1e-9)
        if r.keep_probability in (0.0, 1.0):
            assert r.sampled == bool(r.keep_probability)


def test_topics_against_brute_force(spark):
    import math

    from gaugeline.llm import topics
    from gaugeline.llm._text import word_hashes

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = topics.learn(docs)
    assert len(model.centroids) == topics.TOPICS
    got = topics.assign(docs, model, tokens="n").collect()
    assert len({r.topic for r in got}) > 4
    for r in got[:60]:
        words = (r.text or "").encode().lower().split()
        counts: dict = {}
        for w in words:
            if len(w) >= topics.LEAST:
                h = int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) % topics.DIM
                counts[h] = counts.get(h, 0) + 1
        vec = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        cos = [sum(x * float(c[k]) for k, x in vec.items()) for c in model.centroids]
        assert r.n == len(words)
        if not counts:
            assert r.topic == topics.NONE
        else:
            assert cos[int(r.topic[-2:])] == pytest.approx(max(cos), rel=1e-4)
    assert topics.learn(docs.limit(0)) is None and {r.topic for r in topics.assign(docs, None).collect()} == {topics.NONE}


def test_topics_are_learned_from_every_text(spark):
    """No text is left out of the model: 9000 texts, of which one in 300 has words of its own."""
    import numpy as np

    from gaugeline.llm import topics

    df = spark.range(9000).selectExpr("id as doc_id", "if(id % 300 = 7, concat('zebra', id, ' quagga', id), concat('common words here number', id % 5)) as text").union(spark.sql("select -1L, null union all select -2L, 'a b'"))
    model = topics.learn(df, topics=3)
    again = topics.learn(df.repartition(7), topics=3)
    assert np.array_equal(model.idf, again.idf) and np.array_equal(model.centroids, again.centroids)
    counts = np.zeros(topics.DIM)
    for r in df.where("text is not null").collect():
        raw = r.text.encode()
        counts[np.unique(topics._cells(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1])] += 1
    assert np.allclose(model.idf, np.log(9001 / (1 + counts)) + 0.01, rtol=1e-6)


def test_contradicting_targets_are_reported(spark):
    # each source has one language, so the two dimensions' targets cannot both be met
    df = spark.createDataFrame([(1, "a b", "x", "en"), (2, "c d e", "y", "de")], "doc_id long, text string, source string, lang string")
    targets = {"source": {"x": 0.5, "y": 0.5}, "lang": {"en": 0.9, "de": 0.1}}
    for cells in (mixing.MOST_CELLS, 1):
        with pytest.warns(UserWarning, match="raking ended with an error"):
            mixing.SWEEPS, keep = 5, mixing.SWEEPS
            try:
                mixing.mix(spark, df, targets, topic=F.lit("t"), most_cells=cells).count()
            finally:
                mixing.SWEEPS = keep


def test_tables_agree_with_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for targets in (None, {"lang": {"en": 0.5, "de": 0.5}}):
        topic = F.substring("text", 1, 1)
        small = {r.doc_id: r for r in mixing.mix(spark, docs, targets, topic=F.when(topic < "m", "a").otherwise("b")).collect()}
        large = {r.doc_id: r for r in mixing.mix(spark, docs, targets, topic=F.when(topic < "m", "a").otherwise("b"), most_cells=3).collect()}
        for k, r in small.items():
            assert large[k].keep_probability == pytest.approx(r.keep_probability, rel=1e-9), k
            assert large[k].mix_weight == pytest.approx(r.mix_weight, rel=1e-9), k
            assert large[k].sampled == r.sampled
