import collections

import numpy as np
import pytest

from gaugeline.llm import components, minhash
from gaugeline.llm._store import Scratch
from gaugeline.llm.components import connected_components


def brute(rows, size=2, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in inverted[s])
        for s in sets[i]:
            inverted[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, **options).collect()}


def near_copies(rng, base, n, rate):
    return [" ".join(f"w{rng.integers(10**6)}" if rng.random() < rate * rng.random() else w for w in base) for _ in range(n)]


def test_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"v{k}" for k in range(60)]
    texts = near_copies(rng, base, 80, 0.14) + near_copies(rng, base[::-1], 30, 0.1) + [" ".join(f"z{rng.integers(500)}" for _ in range(40)) for _ in range(40)]
    texts += ["", None, "one", "ONE", "one two", "one two one two", "two one", "x " * 50]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    assert run(spark, rows, shingle_words=2) == brute(rows)
    assert run(spark, rows, shingle_words=5) == brute(rows, 5)


def test_blocks_and_rounds_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = list(enumerate(near_copies(rng, [f"v{k}" for k in range(50)], 60, 0.2)))
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert run(spark, rows, shingle_words=2) == brute(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, shingle_words=2) == brute(rows)


def test_rows(spark):
    rows = [(None, "a b c", 1), (5, "a b c", 2), (5, "a b c", 3), (3, "A  b\tc", 4), (9, None, 5), (7, "x y z", 6), (7, "q r s", 7), (None, "only null ids", 8), (None, "only null ids", 9), (8, "x y z", 10), (3, "a b c", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands int").selectExpr("*", "1 as id", "2 as doc", "3 as text_hash", "4 as component", "5 as least")
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, df, shingle_words=2).collect()), key=str)
    want = [(None, 2, 3, False), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, False), (9, 0, 9, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (None, 2, None, True), (None, 2, None, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 60_000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:57_000], "new"])), (3, " ".join(base[:30_000])), (4, "y " * 200_000), (5, "Y " * 3)]
    assert run(spark, rows, shingle_words=2) == brute(rows)


def test_hubs_are_dealt_out(spark, monkeypatch):
    """A bucket's centre with very many pairs, and a node with very many edges, whatever counts as many."""
    from gaugeline.llm import _skew

    monkeypatch.setattr(_skew, "HOT_ROWS", 3)
    monkeypatch.setattr(_skew, "HOT_KEYS", 20)
    monkeypatch.setattr(_skew, "BUCKETS", 16)
    monkeypatch.setattr(components, "FEW", 0)
    rng = np.random.default_rng(11)
    rows = list(enumerate(near_copies(rng, [f"v{k}" for k in range(60)], 90, 0.1)))
    assert run(spark, rows, shingle_words=2) == brute(rows)
    star = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(100, 101)], "src long, dst long")
    assert {r.id: r.component for r in connected_components(star, Scratch(spark, "t")).collect()} == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    for n in (2000, 40):
        sig = minhash.superminhash(np.concatenate([a[-n:], b[:n]]) if n == 2000 else np.concatenate([x[:n], x[n // 2 : n // 2 + n]]), np.array([0, n, 2 * n]), 512)
        assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.08
    whole = minhash.superminhash(a, np.array([0, 2000]), 64)
    assert (minhash.superminhash(np.concatenate([a, a]), np.array([0, 4000]), 64) == whole).all()
    assert (minhash.superminhash(a[:0], np.array([0, 0]), 8) == 8).all()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (52, 51), (51, 50)], [(9, 4), (4, 7), (2, 9), (30, 31)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            group = {x for x in parent if parent[x] in (parent.get(a, a), parent.get(b, b))} | {a, b}
            low = min(min(group), parent.get(a, a), parent.get(b, b))
            parent |= dict.fromkeys(group, low)
    assert got == parent


def test_few_edges_take_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(17)
    edges = rng.integers(0, 400, (260, 2)).tolist() + [[k, k + 1] for k in range(1000, 1200)] + [[2000, k] for k in rng.permutation(np.arange(1500, 1600)).tolist()]
    df = spark.createDataFrame(edges, "src long, dst long")
    kept = []

    class Counted(Scratch):
        def keep(self, df, table):
            kept.append(table)
            return super().keep(df, table)

    got = {r.id: r.component for r in connected_components(df, Counted(spark, "t"), "few").collect()}
    assert kept == ["few-0"]
    monkeypatch.setattr(components, "FEW", 0)
    assert got == {r.id: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
