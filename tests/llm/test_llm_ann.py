import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import ann


def exact(ids, x, q, k):
    sim = np.array([ann.cosines(x[j : j + 1], x[q])[0] if j != q else -9 for j in range(len(x))])
    return np.lexsort((ids, -sim))[: min(k, len(x) - 1)], sim


def test_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:520] = x[7]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(spark, df, F.col("vec_id") % 50 == 0, k=5, query_block=25).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 50))
    hit = 0
    ids = np.arange(3000)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        want, sim = exact(ids, x, q, 5)
        hit += len({r[1] for r in rows} & set(want.tolist()))
        assert all(r[2] == sim[r[1]] for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
    assert hit / (5 * len(got)) >= 0.95
    assert [r[1] for r in got[500]][:5] == [7, 501, 502, 503, 504]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in ann.search(spark, df, F.pmod("vec_id", F.lit(50)) == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = [len(got[ids[q]] & set(ids[exact(ids, x, q, 5)[0]].tolist())) for q in np.flatnonzero(ids % 50 == 0)]
    assert np.mean(found) / 5 >= 0.95


@pytest.mark.parametrize("radius", [0, 3, 16, 37, 64, 200, 256])
def test_index_returns_exactly_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 256, (400, 32), dtype=np.uint8)
    codes[1] = codes[0]
    codes[2, :3] = codes[0, :3] ^ np.array([1, 2, 4], np.uint8)
    codes[2, 3:] = codes[0, 3:]
    index = ann.MultiIndex(codes)
    for q in (codes[0], codes[9], rng.integers(0, 256, 32, dtype=np.uint8)):
        assert index.within(q, radius).tolist() == np.flatnonzero(ann.distances(codes, q) <= radius).tolist()


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 0.0]), (150, [-1.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as rank", "3 as score", "4 as is_query")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(spark, df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6), (0, 3, 150), (150, 1, 0), (150, 2, 5), (150, 3, 6)]
    assert ann.search(spark, df.limit(0), F.lit(True)).count() == 0
    assert ann.search(spark, df.where("vec_id = 50"), F.lit(True)).count() == 0
    assert ann.search(spark, df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 9)]
    rows += [(50, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0]), (8, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(spark, df, F.col("vec_id") == 50, k=5).collect()
    x, ids = np.array([v for _, v in rows]), np.array([k for k, _ in rows])
    want = []
    for q in (8, 9):
        sim = ann.cosines(x, x[q])
        order = [j for j in np.lexsort((ids, -sim)) if j != q][:5]
        want += [(50, n + 1, int(ids[j]), float(sim[j])) for n, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)
