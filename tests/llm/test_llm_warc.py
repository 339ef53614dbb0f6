import base64
import glob
import gzip
import hashlib

import numpy as np
import pytest

from gaugeline.llm import warc


def sha(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


@pytest.fixture(scope="module")
def archived(spark):
    rows = [(k, f"http://www.a{k % 3}.example.com/p/{k}?q={k}#top", f"<html>\r\n\r\né {k % 4}</html>") for k in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://a1.example.com/p/1?q=1", "x" * 100_000), (103, "bad url [", "line\nline"), (104, "http://A1.example.com:80/P/1?q=1", "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as body", "1 as payload_digest")
    back, index = warc.archive_pages(spark, df)
    return rows, back.collect(), index


def test_round_trip(archived):
    rows, back, _ = archived
    got = {r.page_id: r for r in back}
    assert len(back) == len(rows)
    last = {}
    for k, _, html in rows:
        last[html or ""] = max(k, last.get(html or "", -1))
    for k, url, html in rows:
        r, body = got[k], html or ""
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), sha(body))
        assert (r.record_type, r.refers_to) == (("response", None) if last[body] == k else ("revisit", last[body]))
        assert r.url == url
        if r.record_type == "response":
            assert bytes(r.body).decode() == body


def test_files_are_plain_gzip(archived):
    _, back, _ = archived
    for path in {r.file for r in back}:
        data = gzip.open(path.removeprefix("file:")).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC/1.1\r\n") == sum(r.file == path for r in back)


def test_lookup(archived):
    rows, back, index = archived
    assert index.captures == len(rows)
    for url, want in (("http://a1.example.com/p/1?q=1", [1, 102, 104]), ("https://www.a2.example.com/p/5?q=5", [5]), ("http://none.example.com/", []), (None, [100, 101])):
        found = index.lookup(url)
        assert [c["page_id"] for c in found] == want
        for c in found:
            headers, block = index.read(c)
            assert headers["WARC-Record-ID"] == f"<urn:page:{c['page_id']}>"
            assert headers["WARC-Type"] == c["record_type"]


def test_index_blocks_split_a_key(spark, archived):
    from gaugeline.llm._store import Scratch

    rows = [(k, "http://h.com/same" if k < 50 else f"http://h.com/{k}", "t") for k in range(120)]
    back, _ = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = Scratch(spark, "index").path
    warc.write_index(back, folder, lines=7)
    # a directory of all first keys, and sparser ones
    for keys in (warc.DIRECTORY, 5, 1):
        index = warc.CaptureIndex(spark, folder, keys)
        assert [c["page_id"] for c in index.lookup("http://h.com/same")] == list(range(50))
        assert all([c["page_id"] for c in index.lookup(f"http://h.com/{k}")] == [k] for k in (50, 77, 119))
        assert index.lookup("http://a.com/") == [] and index.lookup("http://z.com/") == []


def test_records_come_by_the_index(spark, archived, monkeypatch):
    _, back, index = archived
    archives = back[0].file.rsplit("/", 1)[0]
    scanned = warc.read_archives(spark, archives).collect()
    order = lambda rows: sorted(map(repr, rows))
    assert order(back) == order(scanned)
    # any other store: files by Spark's reader, ranges from the index
    other = archives.replace("file:", "FILE:", 1) if archives.startswith("file:") else archives
    monkeypatch.setattr(warc, "_files", lambda s, f, real=warc._files: real(s, f.replace("FILE:", "file:", 1)))
    assert order(index.records(other).collect()) == order(scanned)
    # an index without its last line, or with a wrong offset, does not go unnoticed
    lines = index.ranges().orderBy("file", "offset")
    monkeypatch.setattr(index, "ranges", lambda: lines.limit(len(back) - 1))
    assert index.records(archives).count() == len(back) - 1
    monkeypatch.setattr(index, "ranges", lambda: lines.selectExpr("file", "offset + 1 as offset", "length"))
    with pytest.raises(Exception, match="incorrect header|invalid|zlib"):
        index.records(archives).count()


def test_files_are_split_by_bytes(spark):
    from gaugeline.llm._store import Scratch

    rng = np.random.default_rng(1)
    pages = [(k, f"http://h.com/{k}", "".join(chr(c) for c in rng.integers(33, 5000, 400))) for k in range(60)] + [(99, "http://h.com/long", "long page " * 300_000)]
    folder = f"{Scratch(spark, 'split').path}/archives"
    warc.write_archives(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)), folder, file_bytes=5000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(folder).select("length").collect()]
    assert len(sizes) > 8 and max(sizes) < 40_000
    back = {r.page_id: bytes(r.body).decode() for r in warc.read_archives(spark, folder).collect()}
    assert back == {k: html for k, _, html in pages}


def test_threshold_and_rows(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd"), (5, "u", "new"), (5, "u", "new")], "page_id long, url string, html string")
    back, _ = warc.archive_pages(spark, df, least=3)
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in back.collect()) == [
        (-1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "response", None)
    ]
    empty, index = warc.archive_pages(spark, df.limit(0))
    assert empty.count() == 0 and index.lookup("u") == []


def test_keys():
    assert warc.url_key("http://Blog.A.com:80/X?y#z") == "com,a,blog)/x?y"
    assert warc.url_key("https://www.a.com") == "com,a)/"
    assert warc.url_key(None) == ")" and warc.url_key("mailto:x") == ")mailto:x"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(gzip.compress(b"x" * 1000)[:20]))
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse_record(b"HTTP/1.1\r\n\r\n")


def test_a_folder_without_a_scheme_lies_in_the_default_store(spark, archived):
    _, back, index = archived
    archives = back[0].file.rsplit("/", 1)[0]
    plain = archives.removeprefix("file:").replace("///", "/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    assert warc._mounted(spark, archives) and warc._mounted(spark, plain)
    assert index.records(plain).count() == len(back)
    try:
        conf.set("fs.defaultFS", "hdfs://elsewhere:8020")
        assert not warc._mounted(spark, plain) and warc._mounted(spark, archives)
    finally:
        conf.set("fs.defaultFS", default)
