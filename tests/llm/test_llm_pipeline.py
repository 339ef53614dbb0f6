import duckdb
import pytest

import corpus_pipeline
from gaugeline.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{k}" for k in range(1, 14)] and names[-1] == "pipeline"
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    filler = " ".join(f"wort{k}" for k in range(80))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [
        (9001, filler, "en", "s", 1), (9002, filler + " more", None, "s", 1), (9003, "12345 !!! 67", "en", "s", 1), (9004, None, None, None, None),
        (9005, "prolog one two three " + bench + " epilog", "en", "s", 1), (9006, "unique start here " + filler[:330] + " unique end there and some more words that are nowhere else at all", "en", "s", 1),
    ]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    columns = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        if name != "source_mixing":
            assert docs.columns == columns
        docs = docs.persist()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        ids.append((name, before, after))
    gone = {n: set(b) - set(a) for n, b, a in ids}
    assert {9003, 9004} <= gone["language_id"] and len(gone["language_id"]) < 10
    assert 9002 in gone["minhash_near_dedup"] and 9001 not in gone["minhash_near_dedup"]
    suffix = ids[2]
    assert "wort20 " not in suffix[2].get(9001, "") and suffix[2][9006].startswith("unique start here ")
    assert 9005 in gone["benchmark_decontamination"]
    assert 0.4 < len(ids[4][2]) / len(ids[4][1]) < 0.95


def brute_near(rows):
    """What the near-duplicate stage keeps: the first of each group by (id, nulls last)."""
    from tests.llm.test_llm_minhash import brute

    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows})
    groups = brute([(i, t) for i, (_, _, t) in enumerate(order)], 5)
    return [(None if order[i][0] else order[i][1], order[i][2]) for i, (n, root) in groups.items() if not n or root == i]


def brute_repeats(rows):
    from tests.llm.test_llm_suffix import brute

    out = []
    for r, (_, n, _, kept) in zip(rows, brute([x.text for x in rows], 200), strict=True):
        if n == 0 or kept.strip():
            out.append((r.doc_id, kept.decode("utf-8", "ignore")))
    return sorted(out, key=str)


def brute_leaks(rows, items):
    from tests.llm.test_llm_decontaminate import brute, words

    grams = {tuple(w[k : k + min(5, len(w))]) for w in (words(t) for t in items) for k in range(len(w) - min(5, len(w)) + 1)}
    sizes = {len(g) for g in grams}
    out = []
    for r in rows:
        w = words(r.text)
        if any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1)) and any(brute(r.text, t) >= 0.8 - 1e-9 for t in items):
            continue
        out.append(r.doc_id)
    return sorted(out, key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 700").first()
    extra = [(first.doc_id, "another text under an id that is taken, with enough words", "en", "s", 1), (None, first.text, "en", "s", 1), (None, "no id and a text of its own, which is long enough", "en", "s", 1), (None, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    got = stage["minhash_near_dedup"](spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted(brute_near(rows), key=str)
    got = stage["suffix_array_dedup"](spark, docs, SF).collect()
    want = brute_repeats(rows)
    # a cut through a character leaves it whole here and drops it there, so only other texts are compared
    assert len(got) == len(want) and all(len(r.text) == r.n_chars for r in got)
    assert {x for x in want if x[1].isascii()} == {(r.doc_id, r.text) for r in got if r.text.isascii()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = stage["benchmark_decontamination"](spark, docs, SF).collect()
    assert sorted((r.doc_id for r in got), key=str) == brute_leaks(rows, items)


def test_ids_that_do_not_identify(spark):
    """Three rows with three texts, two of them with one id and one without: every stage keeps all three."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 500 and 900 and lang = 'en'").orderBy("doc_id").collect()]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame([(1, texts[0], "en", "a", 1), (1, texts[3], "en", "a", 1), (None, texts[6], "en", "a", 1)], base.schema)
    docs = docs.unionByName(docs.where("doc_id is null"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        # the row that occurs twice is one document from the near-duplicate stage on
        assert docs.count() == (4 if name == "language_id" else 3), name
    assert sorted(r.text[:40] for r in docs.collect()) == sorted(texts[k][:40] for k in (0, 3, 6))


def test_any_column_names(spark):
    names = ["id", "row_a", "row_b", "spans", "kept", "n_removed", "n_spans", "n_bytes", "carried", "matches", "maybe", "lang_pred", "score", "rejected", "_s", "_t", "cell_source", "tokens", "text_hash", "by_id", "no_id", "extra_0", "EXTRA_1", "topic", "sampled", "component", "key"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = base.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)]).persist()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows
        if name == "source_mixing":
            assert set(names) - {"topic", "sampled"} <= set(out.columns)
        else:
            assert out.columns == docs.columns
            assert all(r[n] == i for r in rows for i, n in enumerate(names))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
