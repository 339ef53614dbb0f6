"""WARC archives with a two-level capture index.

Archives are gzip members of one record each, packed into files of about FILE_BYTES and written by Spark's text writer,
which passes bytes through: the line separator is an empty gzip member, so a file is a plain multi-member ``.warc.gz``
that any store of Spark's can hold. The index has a line for each capture, sorted by reversed-host URL key and page.
Lines are packed into compressed blocks; a sparse directory keeps first keys of blocks. A lookup searches the directory,
then one block, and reads the record by its byte range; ``CaptureIndex.records`` does so for all captures at once.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm._skew import join_by_key
from gaugeline.llm._store import Scratch, partitions

#: Compressed bytes after which an archive file is closed; a larger record has a file of its own.
FILE_BYTES = 16 << 20
#: Captures in a block of the index, and first keys in the directory on the driver (about so many).
BLOCK_LINES, DIRECTORY = 1000, 100_000
#: Fixed values of the format: an empty gzip member (header, empty block, zero checksum and size).
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits give four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://blog.a.com:80/x?y`` gives ``com,a,blog)/x?y``; scheme, www., port and fragment go.

    A null or broken URL gives a key of its raw text after ``)``.
    """
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").lower()
    except ValueError:
        return f"){url}"
    if not host:
        return f"){url or ''}"
    host = host[4:] if host.startswith("www.") else host
    return f"{','.join(reversed(host.split('.')))}){(u.path or '/').lower()}{'?' + u.query if u.query else ''}"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, body, payload_bytes, payload_digest, record_type, refers_to) for each page.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response, the others
    revisit it; smaller payloads are always responses. Null payloads are empty. The largest id of a payload is one
    combined aggregate and is joined back by digest; the rows of a very common payload are dealt by page.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("body").cast("long"), "payload_digest": payload_digest(F.col("body").cast("binary"))})
    last = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("members"))
    # a payload that one page has needs no partner
    last = last.where("members > 1")
    revisit = F.col("last").isNotNull() & (F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("last"))
    joined = join_by_key(rows, last, ["payload_digest"], pages.count(), F.struct("page_id", "url"), all_rows=True)
    return joined.select(
        "page_id", "url", "body", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to")
    )


def _urn(page: int | None) -> str:
    return f"<urn:page:{page}>"


def _clean(x: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in x)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes one gzip member for each record; a response carries an HTTP head and the payload, a revisit the head only.

    A task closes a file once its members have ``file_bytes`` bytes, so no file is much larger than that or one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
                block = http + (r["body"].encode() if r["record_type"] == "response" else b"")
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {r['record_type']}",
                    f"WARC-Record-ID: {_urn(r['page_id'])}",
                    f"WARC-Date: {CAPTURE_DATE}",
                    f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                    f"X-Payload-Length: {r['payload_bytes']}",
                    "Content-Type: application/http; msgtype=response",
                ]
                if r["url"] is not None:
                    head.insert(4, f"WARC-Target-URI: {_clean(r['url'])}")
                if r["record_type"] == "revisit":
                    head += [f"WARC-Refers-To: {_urn(r['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                head.append(f"Content-Length: {len(block)}")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
                members.append(packer.compress(raw) + packer.flush())
                size += len(members[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["file"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["file"])

    # the writer copies a string's bytes as they are
    packed = records.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    packed.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(folder)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("record is cut short")
    return headers, block


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that is not empty."""
    at, n = 0, len(data)
    view = memoryview(data)
    while at < n:
        d = zlib.decompressobj(31)
        # fed in pieces: what is left over is copied once a piece, not once a file
        out, end = [], at
        while not d.eof:
            if end >= n:
                raise ValueError("archive is cut short")
            piece = view[end : end + (1 << 16)]
            out.append(d.decompress(piece))
            end += len(piece)
        end -= len(d.unused_data)
        body = b"".join(out)
        if body:
            yield at, end - at, body
        at = end


_NAMES = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "body", "file", "offset", "length"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, body binary, file string, offset long, length long"


def _number(urn: str | None) -> int | None:
    tail = None if urn is None else urn[len("<urn:page:") : -1]
    return None if tail in (None, "None") else int(tail)


def _record(raw: bytes, file: str, at: int, length: int) -> tuple:
    """A record as a row; a response's digest and length are taken from the payload that was read."""
    h, block = parse_record(raw)
    payload = block.partition(b"\r\n\r\n")[2]
    full = h["WARC-Type"] == "response"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else h["WARC-Payload-Digest"].removeprefix("sha1:")
    n = len(payload) if full else int(h["X-Payload-Length"])
    return _number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], digest, n, _number(h.get("WARC-Refers-To")), payload, file, at, length


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of _RECORD in batches of about 4 MB of payload."""
    held: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
        held.clear()
        return out

    for r in rows:
        held.append(r)
        size += len(r[6]) + 256
        if size > 1 << 22:
            yield close()
            size = 0
    if held:
        yield close()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, front to back: (page_id, url, record_type, payload_digest, payload_bytes, refers_to, body, file, offset, length).

    A response's digest and length are taken anew from the payload that was read, a revisit's from its headers.
    Files are read whole, one at a time in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batched(_record(raw, path.as_py(), at, length) for at, length, raw in members(data.as_py()))

    return _files(spark, folder).mapInArrow(run, _RECORD)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def write_index(records: DataFrame, folder: str, lines: int = BLOCK_LINES) -> None:
    """Writes the blocks (first_key, block, n) of the captures (url, page_id, file, offset, length, record_type, payload_digest).

    Rows are dealt by ranges of (key, page), so one host's captures spread over partitions; each partition packs its
    sorted lines into zlib blocks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), *batch.columns], ["key", *batch.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            raw = "\n".join(json.dumps(r) for r in held).encode()
            out = pa.RecordBatch.from_arrays([pa.array([held[0]["key"]]), pa.array([zlib.compress(raw, 6)], pa.binary()), pa.array([len(held)], pa.int64())], ["first_key", "block", "n"])
            held.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                if len(held) == lines:
                    yield block()
        if held:
            yield block()

    cols = ["url", "page_id", "file", "offset", "length", "record_type", "payload_digest"]
    spread = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = records.select(*cols).mapInArrow(keys, "key string, url string, page_id long, file string, offset long, length long, record_type string, payload_digest string")
    dealt = keyed.repartitionByRange(spread, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    dealt.mapInArrow(pack, "first_key string, block binary, n long").write.mode("overwrite").parquet(folder)


def _mounted(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the path themselves; one without a scheme lies in the cluster's default store."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    scheme = fs.Path(path).toUri().getScheme() or fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    return scheme == "file"


class CaptureIndex:
    """Looks URLs up: the sparse directory is in memory, blocks and records are read on demand.

    The directory keeps the first key of every block, or of an even share of them (about ``directory`` keys) where there
    are more; a lookup then narrows the blocks between two kept keys by their first keys, which the store filters.
    """

    def __init__(self, spark: SparkSession, folder: str, directory: int = DIRECTORY):
        self.spark, self.folder = spark, folder
        self.blocks = spark.read.parquet(folder)
        size = self.blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("captures")).first()
        self.captures = size["captures"]
        self.step = max(1, -(-size["blocks"] // directory))
        kept = self.blocks.where(F.pmod(F.xxhash64("first_key"), F.lit(self.step)) == 0)
        self.first = sorted(r["first_key"] for r in kept.select("first_key").collect())

    def _blocks_of(self, key: str) -> DataFrame:
        """The blocks that can hold the key: those that begin with it, and the last one that begins before it."""
        at = bisect.bisect_left(self.first, key)
        upto = self.blocks.where(F.col("first_key") <= F.lit(key))
        if at:
            upto = upto.where(F.col("first_key") >= F.lit(self.first[at - 1]))
        if self.step > 1:
            before = upto.where(F.col("first_key") < F.lit(key)).agg(F.max("first_key")).first()[0]
            if before is not None:
                upto = upto.where(F.col("first_key") >= F.lit(before))
        return upto

    def lookup(self, url: str) -> list[dict]:
        """The captures of a URL's key, in order of page."""
        key = url_key(url)
        out = []
        for r in self._blocks_of(key).select("block").toLocalIterator():
            rows = [json.loads(x) for x in zlib.decompress(bytes(r["block"])).decode().split("\n")]
            keys = [x["key"] for x in rows]
            out += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        return sorted(out, key=lambda x: x["page_id"] if x["page_id"] is not None else -1)

    def read(self, capture: dict) -> tuple[dict[str, str], bytes]:
        """Reads one record by its byte range, from any store that Spark reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(capture["file"])
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(capture["offset"])
            data = bytes(stream.readNBytes(capture["length"]))
        finally:
            stream.close()
        return parse_record(zlib.decompress(data, 31))

    def ranges(self) -> DataFrame:
        """(file, offset, length) of every capture, unpacked from the blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    rows = [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in (("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))], ["file", "offset", "length"])

        return self.blocks.select("block").mapInArrow(run, "file string, offset long, length long")

    def records(self, archives: str) -> DataFrame:
        """Every capture's record, read by its byte range: the rows of ``read_archives``, by way of the index alone.

        Ranges are dealt by file and sorted. Files of a mounted file system are opened by the tasks, which read nothing
        but the ranges; in other stores Spark reads each file, FILE_BYTES or one record long, and the ranges are taken
        from it. Bytes that are no record end the job.
        """
        if _mounted(self.spark, archives):

            def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def rows() -> Iterator[tuple]:
                    name, stream = None, None
                    try:
                        for batch in batches:
                            for file, at, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                                if file != name:
                                    if stream is not None:
                                        stream.close()
                                    name, stream = file, open(file.removeprefix("file:").replace("//", "/"), "rb")
                                stream.seek(at)
                                yield _record(zlib.decompress(stream.read(length), 31), file, at, length)
                    finally:
                        if stream is not None:
                            stream.close()

                yield from _batched(rows())

            dealt = self.ranges().repartition(partitions(self.spark), "file").sortWithinPartitions("file", "offset")
            return dealt.mapInArrow(seek, _RECORD)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    file, data = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                    yield from _batched(_record(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31), file, r["offset"], r["length"]) for r in batch.column(2)[i].as_py())

        lists = self.ranges().groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
        return _files(self.spark, archives).join(lists, "path").select("path", "content", "ranges").mapInArrow(cut, _RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> tuple[DataFrame, CaptureIndex]:
    """Writes archives and index of all pages into the shared folder and returns (records read back through the index, index).

    Archives are read front to back once, to index them; what is returned comes from the index's byte ranges. A null or
    repeated page_id is a record like any other (of equal ids and payloads neither revisits the other); null and empty
    pages are empty payloads, very long ones have a file of their own; other columns are not read.
    """
    scratch = Scratch(spark, "warc")
    archives = f"{scratch.path}/archives"
    write_archives(plan_records(pages, id_col, url_col, body_col, least), archives)
    captures = scratch.keep(read_archives(spark, archives).drop("body"), "captures")
    write_index(captures, f"{scratch.path}/index")
    scratch.drop("captures")
    index = CaptureIndex(spark, f"{scratch.path}/index")
    return index.records(archives), index
