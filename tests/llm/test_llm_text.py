import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import _text

TEXTS = st.lists(st.text(alphabet=st.sampled_from("aAbB \t\n\x0b\x0c\r\x1cé€"), max_size=30), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    col = pa.array(texts, pa.string())
    want = [re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for t in texts]
    got_words, seen, grams_seen = [], {}, {}
    for lo, hi, data, at in _text.chunks(col, target=7):
        h, by = _text.word_hashes(data, at)
        for i in range(hi - lo):
            mine = h[by[i] : by[i + 1]].tolist()
            got_words.append(mine)
            for a, b in zip(mine, want[lo + i], strict=True):
                assert seen.setdefault(b, a) == a
        for size in (1, 2, 3):
            s, sb = _text.shingle_hashes(h, by, size)
            for i in range(hi - lo):
                w = want[lo + i]
                n = len(w) - size + 1 if len(w) >= size else min(len(w), 1)
                assert sb[i + 1] - sb[i] == n
                grams = [tuple(w[k : k + size]) for k in range(n)] if len(w) >= size else [tuple(w)] * n
                for g, x in zip(grams, s[sb[i] : sb[i + 1]].tolist(), strict=True):
                    assert grams_seen.setdefault(g, x) == x
    assert len(got_words) == len(texts)
    assert len(set(seen.values())) == len(seen) and len(set(grams_seen.values())) == len(grams_seen)


def test_nulls_and_slices():
    col = pa.array(["ab", None, "", "c d"], pa.string())
    data, at = _text.string_buffers(col.slice(1))
    assert at.tolist() == [0, 0, 0, 3] and data.tobytes() == b"c d"
    assert list(_text.chunks(pa.array([], pa.string()))) == []


def test_span_hash_ignores_place():
    x = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    p = _text.prefix_hash(_text.BYTE_HASH[x])
    h = _text.span_hash(p, np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2]))
    assert h[0] == h[1] != h[2] and h[3] != h[0]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_long_patterns_do_not_collide():
    for n in (128, 512, 1024, 4096):
        for one, two in (b"ab", b"09", b"\x00\xff"):
            a = np.array([(one, two)[b] for b in thue_morse(n)], np.uint8)
            b = np.array([(two, one)[b] for b in thue_morse(n)], np.uint8)
            p = _text.prefix_hash(_text.BYTE_HASH[np.concatenate([a, b, a])])
            h = _text.span_hash(p, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
            assert h[0] != h[1] and h[0] == h[2]


def test_long_words_are_told_apart():
    a, b = (bytes((x, y)[k] for k in thue_morse(2048)) for x, y in (b"ab", b"ba"))
    text = b" ".join([a, b, a, b"short"])
    h, _ = _text.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
