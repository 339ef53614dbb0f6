import hashlib
import time

import numpy as np
import pytest

from gaugeline.llm import induced
from gaugeline.llm.suffix_dedup import remove_repeats


def brute_suffixes(texts, cap):
    rows, off = [], 1
    for i, x in enumerate(t for t in texts if t):
        rows += [(x[j:], i, off + j) for j in range(len(x))]
        off += len(x) + 1
    rows.sort(key=lambda r: (r[0], r[1]))
    lcp = [0]
    for (a, _, _), (b, _, _) in zip(rows, rows[1:]):
        k = 0
        while k < min(len(a), len(b), cap) and a[k] == b[k]:
            k += 1
        lcp.append(k)
    return [r[2] for r in rows], lcp[: len(rows)]


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed, monkeypatch, tmp_path):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(induced, "BLOCK", int(rng.integers(1, 20)))
    letters = int(rng.integers(1, 5))
    texts = [bytes(rng.integers(97, 97 + letters, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
    texts += [texts[0] * 3] * (seed % 2)
    cap = int(rng.choice([3, 5, 200]))
    pos, lcp, _ = induced.suffix_array(texts, cap, base_case=int(rng.choice([4, 1000])), budget=int(rng.choice([50, 1 << 20])), folder=str(tmp_path))
    want = brute_suffixes(texts, cap)
    assert lcp.tolist() == want[1]
    assert sorted(pos.tolist()) == sorted(want[0])


def test_extremes(tmp_path):
    for texts in ([b"-" * 500, b"x" + b"-" * 400 + b"y"], [bytes(range(256)), bytes(range(255, -1, -1))], [b"a"], [b"\0\0\0", b"\xff" * 9]):
        assert induced.suffix_array(texts, 200)[1].tolist() == brute_suffixes(texts, 200)[1]
    assert len(induced.suffix_array([b""], 200)[0]) == 0


def test_small_memory_spills_and_recurses(tmp_path):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 20_000).astype(np.uint8))
    seen = []
    t, raw, _ = induced.layout([text])
    stats = induced.induced_sort(t, lambda p, x: seen.append((p.copy(), x.copy())), 50, str(tmp_path), budget=2000, base_case=500, raw=raw)
    assert stats["levels"] > 1 and stats["spilled"] > 100_000
    pos = np.concatenate([p for p, _ in seen])[::-1]
    want = sorted(range(len(text)), key=lambda i: text[i : i + 60])
    assert [text[p - 1 : p + 59] for p in pos] == [text[i : i + 60] for i in want]


def brute(texts, length):
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        cover = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(x), sum(cover), spans, bytes(b for b, c in zip(x, cover) if not c)))
    return out


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(remove_repeats(spark, df, **options).collect(), key=lambda r: r.id)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows]


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcé"), 3)) for _ in range(12)]
    shared = " ".join(rng.choice(words, 40))
    texts = [None, "", "short", "x" * 300, "ab" * 150, shared, shared, shared[5:] + " tail", "head " + shared[:-7]]
    for _ in range(12):
        a, b = sorted(rng.integers(0, len(shared), 2))
        texts.append(" ".join(rng.choice(words, 20)) + shared[a:b] + " ".join(rng.choice(words, 10)))
    for length, gram in ((20, 8), (20, 20), (50, 16)):
        assert run(spark, texts, length=length, gram=gram) == brute(texts, length)


def test_hot_hashes_are_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gaugeline.llm import suffix_dedup

    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    # a header one byte shorter than a window, among ever different texts; some windows around it do repeat
    header = noise(49)
    texts = [noise(60) + header + noise(60) for _ in range(300)]
    texts += [texts[0], texts[1][:90] + "!", "x" * 70, "x" * 90]
    sizes, sort = [], suffix_dedup._sorted_shards

    def spy(segments, length, shards, spread):
        sizes.extend(r[1] for r in segments.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards))).agg(F.sum(F.octet_length("body"))).collect())
        return sort(segments, length, shards, spread)

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 4000, raising=False)
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", spy)
    assert run(spark, texts, length=50, gram=8) == brute(texts, 50)
    # unsplit, the header's segments make one shard beyond this
    assert max(sizes) < 12_000


def test_only_segments_that_may_share_a_window_are_sorted(spark, monkeypatch):
    from gaugeline.llm import suffix_dedup

    rng = np.random.default_rng(12)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    copies = [noise(400) for _ in range(20)]
    texts = [t + noise(300) for t in copies for _ in range(2)]
    seen, sort = [], suffix_dedup._sorted_shards

    def spy(segments, length, shards, spread):
        seen.append(segments.count())
        return sort(segments, length, shards, spread)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", spy)
    assert run(spark, copies * 2, length=50, gram=16) == brute(copies * 2, 50)
    # every hash has one kind of segment
    assert seen == [0]
    assert run(spark, texts, length=50, gram=16) == brute(texts, 50)


def test_sides_of_a_hash():
    import pyarrow as pa

    from gaugeline.llm import suffix_dedup as s

    rng = np.random.default_rng(13)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    gram, other, shared = noise(8), noise(8), noise(20)
    bodies = [noise(30) + gram + noise(30), noise(30) + gram + noise(30), shared + gram + noise(40), noise(9) + shared + gram + noise(5), noise(20) + other + noise(9) + other, noise(25) + other + noise(20)]
    prefix = [s.prefix_hash(s.BYTE_HASH[np.frombuffer(x, np.uint8)]) for x in (gram, other)]
    key = np.array([s._gram_hashes(p, 8)[0] for p in prefix])[[0, 0, 0, 0, 1, 1]].view(np.int64)
    left, right = s._flanks(pa.array(bodies), key, 40, 8)
    # chance meetings are left out, a shared side and a hash that occurs twice are not
    assert s._sortable(key, left, right).tolist() == [False, False, True, True, True, True]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 2, 2, 3, 3, 4])], ["key"])
    parts = [batch.slice(0, 3), batch.slice(3, 1), batch.slice(4, 0), batch.slice(4, 3), batch.slice(7, 1), batch.slice(8, 1)]
    assert [x.column(0).to_pylist() for x in s._whole_hashes(iter(parts))] == [[1, 1], [2, 2, 2, 2], [3, 3], [4]]


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = sorted(remove_repeats(spark, docs, length=200).collect(), key=lambda r: r.id)
    for r, want in zip(got, brute([x.text for x in rows], 200), strict=True):
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want


def test_whole_characters(spark):
    a, b = "é" * 30, "x" + "é" * 30
    df = spark.createDataFrame([(1, "ê" + a), (2, b)], "doc_id long, text string")
    for r in remove_repeats(spark, df, length=21, gram=8, whole_characters=True).collect():
        assert bytes(r.kept).decode() in ("ê", "x")


def test_a_shard_beyond_its_memory(tmp_path):
    """Ten times the budget and more: arrays and tuples lie in files, names are sorted by recursion."""
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 300, 60)) for _ in range(700)]
    texts += [x[40:200] + y[10:180] for x, y in zip(texts[:80], texts[80:160])] + [b"=" * 3000, b"=" * 90 + b"x"]
    spool = induced.Spool(induced.Files(str(tmp_path), 20_000))
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        spool.add(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
    flag, start, stats = induced.repeated_starts(spool, 60, base_case=10_000)
    assert stats["levels"] > 1 and stats["spilled"] > 10 * 20_000 and stats["mapped"] > 10 * 20_000
    from collections import Counter

    seen = Counter(x[p : p + 60] for x in texts for p in range(len(x) - 59))
    want = {s + p for s, x in zip(start.tolist(), texts) for p in range(len(x) - 59) if seen[x[p : p + 60]] > 1}
    assert len(want) > 5000 and set(np.flatnonzero(flag).tolist()) == want


def test_ranks_from_files(tmp_path):
    rng = np.random.default_rng(9)
    for n, top in ((1, 5), (5000, 40), (30_000, 1 << 62)):
        keys = rng.integers(0, top, n).astype(np.uint64)
        files = induced.Files(str(tmp_path), 4000)
        assert (np.asarray(files.rank(keys)) == np.unique(keys, return_inverse=True)[1]).all()


def test_queries_spill(spark, tmp_path, monkeypatch):
    """The query's own budget sends an ordinary shard's tuples and arrays to files."""
    from gaugeline.llm import suffix_dedup

    texts = [r.text.encode()[:2000] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").limit(1500).collect()]
    spool = induced.Spool(induced.Files(str(tmp_path), suffix_dedup.SORT_BUDGET))
    spool.add(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    stats = induced.repeated_starts(spool, 200, base_case=suffix_dedup.BASE_CASE)[2]
    assert stats["spilled"] > 0 and stats["mapped"] > 0


def test_very_many_equal_rows(spark):
    """A table of one row 20 000 times: nothing grows with the square of the copies."""
    text = " ".join(f"word{k}" for k in range(120))
    df = spark.range(20_000).selectExpr("7L as doc_id", f"'{text}' as text", "id as other").unionByName(spark.createDataFrame([(8, "tail " + text[:400], 0), (9, "short", 1), (9, "short", 2)], "doc_id long, text string, other long"))
    rows = remove_repeats(spark, df, length=200, carry=("other",)).collect()
    assert len(rows) == 20_003 and len({r.other for r in rows if r.id == 7}) == 20_000
    assert {(r.n_removed, r.n_spans, bytes(r.kept)) for r in rows if r.id == 7} == {(len(text), 1, b"")}
    assert [(r.n_removed, bytes(r.kept)) for r in rows if r.id == 8] == [(400, b"tail ")]
    assert [r.n_removed for r in rows if r.id == 9] == [0, 0]


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 3_000_000).astype(np.uint8)).decode()
    got = run(spark, [long, "x" * 400_000, long[1_000_000:1_000_500]])
    assert [g[1:3] for g in got] == [(500, 1), (400_000, 1), (500, 1)]


def test_very_many_runs_in_one_text(spark):
    """A long text that repeats as a whole has a run for each of its segments; nothing grows with their square."""
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 4_000_000).astype(np.uint8)).decode()
    df = spark.createDataFrame([(1, long), (2, long + "!")], "doc_id long, text string")
    out = remove_repeats(spark, df)
    began = time.perf_counter()
    assert sorted((r.id, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == [(1, 4_000_000, 1, b""), (2, 4_000_000, 1, b"!")]
    # compared with each other, the runs took 46 s
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("width", [1, 2, 7, 8])
def test_sliding_minima_in_blocks(width, monkeypatch):
    from gaugeline.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SLIDE", 5)
    x = np.random.default_rng(width).integers(0, 99, 33)
    for least in (np.minimum, np.maximum):
        assert suffix_dedup._sliding(least, x, width).tolist() == [least.reduce(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_columns_named_as_inside(spark):
    names = ["row_a", "row_b", "spans", "runs", "carried", "key", "seg", "members", "again", "text2", "c0", "shard"]
    df = spark.createDataFrame([(1, "abcdefghijkl" * 3, *range(12)), (2, "abcdefghijkl" * 3, *range(12))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for r in remove_repeats(spark, df, length=12, gram=4, carry=tuple(names)).collect():
        assert r.n_removed == 36 and [r[n] for n in names] == list(range(12))
    with pytest.raises(ValueError, match="carried"):
        remove_repeats(spark, df.withColumn("kept", df.c0), length=12, gram=4, carry=("kept",))


def test_rows(spark):
    long = "abcdefghij" * 3
    # null ids, repeated rows, and columns named as inside
    df = spark.createDataFrame([(None, long, 1), (None, "other", 2), (7, long + "!", 3), (7, "unlike", 4), (8, "same row here", 5), (8, "same row here", 5)], "doc_id long, text string, key int").withColumn("start", df_lit())
    out = remove_repeats(spark, df, length=12, gram=4, carry=("key", "start"))
    got = sorted((r.key, r.n_removed, r.start) for r in out.collect())
    assert got == [(1, 30, "s"), (2, 0, "s"), (3, 30, "s"), (4, 0, "s"), (5, 13, "s"), (5, 13, "s")]
    assert remove_repeats(spark, df.limit(0), length=12, gram=4).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    with pytest.raises(ValueError, match="gram"):
        remove_repeats(spark, df, length=10, gram=32)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("s")


def test_texts_that_differ_by_a_thue_morse_pattern_keep_all_bytes(spark):
    # polynomials modulo 2**64 cannot tell these two apart; none of their windows repeats
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    fixed = "".join(rng.choice(letters, 32))
    filler = ["".join(rng.choice(letters, 31)) for _ in range(64)]
    pattern = [bin(i).count("1") & 1 for i in range(64)]
    texts = ["".join(fixed + f + (one, two)[p] for f, p in zip(filler, pattern)) + "".join(rng.choice(letters, 32)) for one, two in ("ab", "ba")]
    for t in texts:
        assert len(t) == 4128
    assert [x[1] for x in brute(texts, 200)] == [0, 0]
    assert run(spark, texts) == brute(texts, 200)
