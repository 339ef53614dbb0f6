"""The prefix trie against a trie that is built node by node."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gaugeline.llm import _skew, trie
from gaugeline.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, share=None):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if share:
        heads = {c: zlib.crc32(str(c).encode()) % share[1] for c in own}
        own = {c: own.get(c - c % share[0], [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}
    members = defaultdict(list)
    for c, path in own.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for v in members:
        if v:
            kids[v[:-1]].append(v)

    def below(v):
        leaves, saved = (0 if kids[v] else 1), (len(members[v]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0)
        for k in kids[v]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for v, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(own[c]) == len(v)))
        out.append((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids[v]), *below(v), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in prefix_trie(spark, spark.createDataFrame(rows, SCHEMA), **how).select(*COLUMNS).collect()), key=repr)


def conversations(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(130), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            # few texts, so that paths share prefixes; a first turn that most have
            text = "hello there  you" if t == 0 and rng.random() < 0.6 else rng.choice(["", "a", "b c", "b\tc\n d", None])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if t else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [None, (20, 4), (1, 2)])
@pytest.mark.parametrize("hot", [2, 10**6])
def test_against_brute_force(spark, monkeypatch, share, hot):
    monkeypatch.setattr(_skew, "HOT_ROWS", hot)
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "BATCH", 5)
    rows = conversations(hash((share, hot)) % 1000)
    assert got(spark, rows, share=share) == brute(rows, share)


def test_turnless_conversations_are_members_of_the_root(spark):
    # ids that take turns of a base that is not there, and have no more of their own
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "x") for c in ids]
    out = got(spark, rows, share=(20, 4))
    assert out == brute(rows, (20, 4)) and len(out) == 1
    assert out[0][:2] == (ids[0], 0) and out[0][3:6] == (3, 0, 1)


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "user", "ab"), (2, 0, "usera", "b"), (3, 0, "", "userab"), (4, 0, "user", "ab")]
    assert got(spark, rows) == brute(rows)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 3, "user", "last"), (8, 0, "", ""), (8, 1, "", "")]
    assert got(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, 1, "x", b"y", 2) for r in rows], SCHEMA + ", depth int, node string, owner binary, base int")
    assert sorted((tuple(r) for r in prefix_trie(spark, wide).select(*COLUMNS).collect()), key=repr) == brute(rows)
    assert got(spark, []) == []


def test_long_texts_and_long_conversations(spark):
    rows = [(c, t, "user", "w " * 3) for c in (1, 2) for t in range(300)] + [(3, 0, "user", "word " * 200_000)]
    out = {(r[0], r[1]): r for r in got(spark, rows)}
    assert len(out) == 302
    assert out[1, 300][3:7] == (2, 0, 1, 3) and out[1, 0][3:7] == (3, 2, 2, 900)
    assert out[3, 1][3:7] == (1, 0, 1, 0)
