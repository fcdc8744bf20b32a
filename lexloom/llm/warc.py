"""WARC archives and their index, merged externally.

Writing: each page is a record of its own gzip member; archives are files of
such members in a folder of the shared file system, written by Spark, each of
ARCHIVE_BYTES and a record at most. Of
records with equal payloads the one of the smallest id holds the payload
(response), the others point to it (revisit), so a payload is stored once.

Reading: each archive is parsed, payloads are checked against their digests,
and its captures are sorted by URL key and time: a run. Splitters from the runs
cut all of them into ranges; in each range the cut runs are merged by a k-way
loser tree. The ranges in order are the whole capture history in order.

A null html is an empty payload, a null url an empty target. Ids are taken to
be unique; of equal rows with the smallest id all are responses. A null id
comes after all others; where all ids are null, all are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Payloads of at least so many bytes are stored once.
REVISIT_FROM = 0
#: An archive ends with the record that takes it to so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Captures in a range of the merge.
RANGE_ROWS = 100_000
LEVEL = 4
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: An archive ends with an empty member, for Spark's text writer wants a separator.
_EMPTY = gzip.compress(b"", mtime=0)
CAPTURE = "urlkey string, timestamp string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
ORDER = ("urlkey", "timestamp", "page_id")


def url_key(url: str) -> str:
    """Host labels reversed, then the path, in lower case: com,example)/a?b."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url, re.I)
    if not m:
        return url.lower()
    host, rest = m[1].rpartition("@")[2].lower(), m[2] or "/"
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", host))
    return ",".join(reversed(host.split("."))) + ")" + rest.lower()


def stamp(page_id: int | None) -> str:
    """The tables have no capture time: one second a page from a fixed day on, within 100 years."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp(page_id)}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of each record in an archive."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        z = zlib.decompressobj(31)
        raw = z.decompress(view[at:])
        if not z.eof:
            raise ValueError(f"the member at {at} is not whole")
        length = len(content) - at - len(z.unused_data)
        if raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at {at}")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            size = int(fields["Content-Length"])
            if len(rest) != size + 4:
                raise ValueError(f"the record at {at} is not whole")
            yield at, length, fields, rest[:size]
        at += length


def _members(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """parse(), a window of the archive at a time, so that unused data isn't copied again and again."""
    step, base, n = 1 << 18, 0, len(content)
    while base < n:
        end = min(base + step, n)
        z = zlib.decompressobj(31)
        raw = z.decompress(content[base:end])
        while not z.eof and end < n:
            more = min(end + step, n)
            raw += z.decompress(content[end:more])
            end = more
        if not z.eof:
            raise ValueError(f"the member at {base} is not whole")
        used = end - len(z.unused_data) - base
        for _, _, fields, block in parse(content[base : base + used]) if raw else ():
            yield base, used, fields, block
        base += used


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives of pages (page_id, url, html) to a new folder."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("bytes", F.octet_length("html"))
    slim = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha"), F.octet_length("html").alias("bytes"))
    grouped = slim.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    # Most payloads stand alone: only those found again need a look-up.
    again = materialise(grouped.filter((F.col("n") > 1) & (F.col("bytes") >= REVISIT_FROM)).select(F.col("sha").alias("again"), "first_id"), "warc-again")
    both = rows.join(again, F.col("sha") == F.col("again"), "left")
    both = both.withColumn("revisit", F.col("again").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole archives, a row each."""
        held = bytearray()
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, sha, first, revisit = (c[i].as_py() for c in b.columns)
                held += record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha).decode(), first, revisit)
                if len(held) >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["archive"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["archive"])

    whole = both.select("page_id", "url", "html", "sha", "first_id", "revisit").mapInArrow(archives, "archive binary")
    # The text writer puts a value's bytes as they are; a row is a file.
    whole.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads the archives back: a run of captures for each, sorted by ORDER, with run and place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows = sorted((row(name, *x) for x in _members(content)), key=key)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(range(len(rows)), pa.int64())], names=[*(c.split()[0] for c in CAPTURE.split(", ")), "place"])

    def row(name: str, offset: int, length: int, head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload at {offset} of {name} is not what its header says")
        number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(x, ""))) else None
        url = head["WARC-Target-URI"]
        return url_key(url), head["WARC-Date"], number("WARC-Record-ID"), url, size, digest, head["WARC-Type"], number("WARC-Refers-To"), name, offset, length

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content").mapInArrow(read, CAPTURE + ", place bigint")


def key(row) -> tuple:
    """The order of captures; null ids are last."""
    return row[0], row[1], row[2] is None, row[2] or 0


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator], rank=key):
        self.runs, self.rank, self.k = runs, rank, max(len(runs), 1)
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else rank(h) for h in self.heads]
        self.tree = [-1] * self.k  # 0 is the winner
        for i in range(self.k):
            self._play(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.keys[i], self.keys[j]
        return b is None and (a is not None or i < j) if a is None or b is None else (a, i) < (b, j)

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.tree[at] < 0:  # the first to come here waits for the other
                self.tree[at] = i
                return
            if self._less(self.tree[at], i):
                self.tree[at], i = i, self.tree[at]
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while True:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.rank(self.heads[i])
            at, w = (i + self.k) // 2, i
            while at > 0:
                if self._less(self.tree[at], w):
                    self.tree[at], w = w, self.tree[at]
                at //= 2
            self.tree[0] = w


def merged(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Merges runs (see captures) by ORDER; `part` is the range, in which rows come in order with `seq` from 0."""
    runs = materialise(runs, "warc-runs")
    count = runs.count()
    n = max(1, -(-count // range_rows))
    cuts = []
    if n > 1:  # splitters: n - 1 of a sample whose size is set by n alone
        rate = min(1.0, 40 * n / count)
        sample = sorted(key(r) for r in runs.filter(F.pmod(F.xxhash64("archive", "place"), F.lit(1 << 20)) < rate * (1 << 20)).select(*ORDER).collect())
        cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    import bisect

    shared = runs.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, t, p = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ORDER)
            at = [bisect.bisect_right(shared.value, key(x)) for x in zip(u, t, p, strict=True)]
            yield b.append_column("part", pa.array(at, pa.int32()))

    ranged = runs.mapInArrow(cut, CAPTURE + ", place bigint, part int")
    placed = ranged.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "archive", "place")
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(LoserTree([iter(held[a]) for a in sorted(held)])) if held else []
            for i in range(0, len(rows), 10_000):
                part = list(zip(*rows[i : i + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f) for c, f in zip(part, types, strict=True)), pa.array([now] * len(part[0]), pa.int32()), pa.array(range(i, i + len(part[0])), pa.int64())], names=[*names, "part", "seq"])

        for b in batches:
            types = [b.schema.field(c).type for c in names]
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
            for k, row in zip(b.column(b.schema.get_field_index("part")).to_pylist(), zip(*cols, strict=True), strict=True):
                if k != now:
                    yield from flush()
                    held, now = {}, k
                held.setdefault(row[8], []).append(row)
        yield from flush()

    return placed.mapInArrow(merge, CAPTURE + ", part int, seq bigint")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back, returns the merged index."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path)
    return merged(captures(spark, path))


def read_record(content: bytes, offset: int, length: int) -> bytes:
    """The payload at a place that the index names."""
    with gzip.open(io.BytesIO(content[offset : offset + length])) as f:
        raw = f.read()
    block = raw.partition(b"\r\n\r\n")[2][:-4]
    return block.partition(b"\r\n\r\n")[2]
