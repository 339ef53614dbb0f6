import numpy as np
import pytest

from gaugeline.llm import decontaminate as d

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the old barn"),
    (2, "Él niño come PAN todos los días por la mañana y después va a la escuela vieja"),
    (3, "tiny item"), (4, ""), (5, None), (6, "the quick BROWN fox, jumps over the lazy dog and runs far away from the old barn!"),
]


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(text, item):
    """Best weighted Jaccard over all windows of the item's length; a shingle weighs its words' bytes."""
    from collections import Counter

    w, q = words(text), words(item)
    if not q or not w:
        return 0.0
    size = min(5, len(q))
    bag = lambda x: Counter(tuple(x[k : k + size]) for k in range(len(x) - size + 1))
    b, best = bag(q), 0.0
    get = lambda g: sum(len(x.encode()) for x in g)
    for s in range(max(1, len(w) - len(q) + 1)):
        a = bag(w[s : s + len(q)])
        low = sum(get(g) * min(a[g], b[g]) for g in a.keys() | b.keys())
        high = sum(get(g) * max(a[g], b[g]) for g in a.keys() | b.keys())
        best = max(best, low / high if high else 0)
    return best


def found(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: [m["item"] for m in r.matches] for r in d.find_contamination(spark, docs, bench, **options).collect()}


def test_passages(spark):
    fox = ITEMS[0][1]
    texts = [
        "before it all. " + fox + "%%% and after", fox.upper().replace(" ", "!! "), "nothing of the kind here", fox.replace("dog", "cat"), fox.replace("barn", "house"), fox[:40],
        None, "", "a tiny item here", "ÉL NIÑO COME pan todos los días por la mañana y después va a la escuela vieja", "x " * 3000 + fox, " ".join(fox.split()[1:]),
    ]
    got = found(spark, texts)
    assert got == {0: [1, 6], 1: [1, 6], 2: [], 3: [], 4: [1, 6], 5: [], 6: [], 7: [], 8: [3], 9: [2], 10: [1, 6], 11: [1, 6]}
    assert found(spark, texts, index_bytes=100) == got


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab, rng.integers(8, 50)))) for k in range(25)]
    texts = []
    for _ in range(60):
        core = words(items[rng.integers(25)][1])
        for _ in range(rng.integers(0, 3)):
            # near an end few shingles change, so that similarities lie around the threshold
            core[min(int(rng.integers(6)), len(core) - 1) * (1 if rng.random() < 0.5 else -1)] = "zz"
        texts.append(" ".join([*rng.choice(vocab, rng.integers(0, 20)), *core, *rng.choice(vocab, rng.integers(0, 20))]))
    sims = {(i, k): brute(text, t) for i, text in enumerate(texts) for k, t in items}
    want = {i: [k for k, _ in items if sims[i, k] >= 0.8 - 1e-9] for i in range(len(texts))}
    assert sum(map(bool, want.values())) > 10
    # many texts lie just below or above the threshold
    assert sum(0.7 < x < 0.8 for x in sims.values()) > 5 and sum(0.8 <= x < 0.9 for x in sims.values()) > 5
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: {r.doc_id: r.matches for r in d.find_contamination(spark, docs, bench, index_bytes=size).collect()}
    got = rows(4 << 20)
    assert {i: [m.item for m in x] for i, x in got.items()} == want
    assert all(m.similarity == pytest.approx(sims[i, m.item], abs=1e-12) for i, x in got.items() for m in x)
    # the size of a block of the index changes nothing, to the last digit
    assert rows(1500) == got and rows(200) == got


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = d.BenchmarkIndex([(k, " ".join(f"w{x}" for x in rng.integers(0, 1000, 20))) for k in range(50)])
    for _ in range(40):
        code = np.unpackbits(index.codes[rng.integers(50)]).copy()
        flip = rng.choice(d.BITS, rng.integers(0, 80), replace=False)
        code[flip] ^= 1
        near = [i for i, c in enumerate(index.codes) if (np.unpackbits(c) ^ code).sum() <= d.RADIUS]
        (group,) = index.groups
        assert [group.number[k] for k in group.within(np.packbits(code)[None])[1]] == near


def test_very_long_texts_and_clashing_columns(spark):
    fox = ITEMS[0][1]
    text = "filler word " * 40_000 + fox + " filler word" * 40_000 + " " + fox
    df = spark.createDataFrame([(1, text, 5, "m", None), (2, "clean", 6, None, [1])], "doc_id long, text string, maybe int, matches string, item array<int>")
    for size in (4 << 20, 60):
        got = {r.doc_id: r for r in d.find_contamination(spark, df, spark.createDataFrame(ITEMS, "item_id long, text string"), index_bytes=size).collect()}
        assert [(m.item, m.word, m.similarity) for m in got[1].matches] == [(1, 80_000, 1.0), (6, 80_000, 1.0)]
        assert got[2].matches == [] and (got[1].maybe, got[2].maybe, got[2].item) == (5, 6, [1])


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a tiny item", "m"), (1, "a tiny item", "m"), (None, "tiny item", None)], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = d.find_contamination(spark, docs, bench).collect()
    assert [len(r.matches) for r in rows] == [1, 1, 1]
    assert d.find_contamination(spark, docs.limit(0), bench).count() == 0
    assert [r.matches for r in d.find_contamination(spark, docs, bench.limit(0)).collect()] == [[], [], []]


@pytest.mark.parametrize("n", [0, 1, 4])
def test_short_items(n):
    index = d.BenchmarkIndex([(7, " ".join("abcd"[:n]))])
    raw = np.frombuffer(b"x a b c d y", dtype=np.uint8)
    assert bool(index.scan(raw, np.array([0, len(raw)]))[0]) is (n > 0)


def test_items_without_an_id(spark):
    text = "one two three four five six seven eight"
    bench = spark.createDataFrame([(None, text), (None, "nine ten eleven twelve thirteen"), (3, text), (None, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + text), (2, "nine ten eleven twelve thirteen"), (3, "clean words only in this text")], "doc_id long, text string")
    for size in (1 << 20, 40):
        got = {r.doc_id: [m.item for m in r.matches] for r in d.find_contamination(spark, df, bench, index_bytes=size).collect()}
        assert sorted(got[1], key=str) == [3, None] and got[2] == [None] and got[3] == []


@pytest.mark.parametrize("n, size", [(60, 6), (200, 80), (300, 120), (500, 200), (1000, 500)])
def test_one_long_word_among_short_ones(n, size):
    """Items whose long word is changed in the document: the similarity stays above the threshold, whatever the weights."""
    rng = np.random.default_rng(n)
    lost = met = 0
    for _ in range(30):
        w = [f"w{x:04d}" for x in rng.integers(0, 9999, n)]
        at = int(rng.integers(n))
        item, text = list(w), list(w)
        item[at], text[at] = "".join(map(chr, rng.integers(97, 123, size))), "".join(map(chr, rng.integers(97, 123, size)))
        if brute(" ".join(text), " ".join(item)) < 0.8:
            continue
        met += 1
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        lost += not d.BenchmarkIndex([(1, " ".join(item))]).scan(raw, np.array([0, len(raw)]))[0]
    assert met >= 10 and lost == 0


def test_repeated_shingles_in_an_item(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{k}" for k in range(500)]
    items, texts = [], []
    for k in range(12):
        # a line that an item has many times outweighs the rest
        line = list(rng.choice(vocab, 6))
        rest = list(rng.choice(vocab, 60))
        items.append((k, " ".join(line * 8 + rest)))
        rest[int(rng.integers(20, 40))] = "changed"
        texts.append(" ".join(["before", *line * 8, *rest, "after"]))
        texts.append(" ".join([*line * 30, *rest]))
    sims = {(i, k): brute(text, t) for i, text in enumerate(texts) for k, t in items}
    want = {i: [k for k, _ in items if sims[i, k] >= 0.8 - 1e-9] for i in range(len(texts))}
    assert sum(map(bool, want.values())) >= 12
    assert found(spark, texts, items) == want


def test_a_word_of_a_megabyte():
    long = b"x" * 1_000_000
    item = b"one two three four " + long + b" five six seven eight"
    index = d.BenchmarkIndex([(1, item.decode())])
    raw = np.frombuffer(b"start " + item + b" end", np.uint8)
    assert [(m[0], m[1]) for m in index.scan(raw, np.array([0, len(raw)]))[0]] == [(1, 1)]
