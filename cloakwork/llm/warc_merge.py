"""WARC archives, and capture histories by an external merge of their indexes.

write_archives() turns each page into a WARC/1.1 record; of records with equal payloads
the one with the smallest id is a response and the others revisit it.  index_runs()
reads archives back, checks payload digests and leaves locally sorted runs of index
lines.  merge_runs() merges runs with loser trees by URL key and time: key ranges taken
from a bounded sample of the runs are merged side by side, at most FAN_IN runs at a
time, and every range reads only its own slice of each run by binary search.  Levels of
a merge of many runs are split by key ranges like the last one.

Archives and runs lie in the folder that driver and executors share.  A task names its
files afresh and reports them with its result, so files of lost attempts are ignored.

Defined cases: null html is an empty payload; a null url is about:blank; rows with a
null id are responses; repeated rows (one id, one payload) are separate records, all of them
responses if theirs is the least id of the payload; a page without a time that can be read
is captured at EPOCH plus its id in seconds; an empty table gives no archive; payloads of
any length are written whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, importable, materialize, new_path

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Runs merged at a time; lines of a run; keys sampled for the ranges, at most.
FAN_IN, RUN_LINES, SAMPLE_KEYS = 64, 200_000, 20_000
#: Lines that one range should hold, about.
RANGE_LINES = 100_000
COLUMNS = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: captures of a site sort together."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").lower()
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return quote(url.lower(), safe="/?&=,:;~!*'()")
    if host.startswith("www."):
        host = host[4:]
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + tail, safe="/?&=,:;~!*'()%+@$")


def _record(page_id, url: str, when: str, payload: bytes, first) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {quote(url, safe='/?&=,:;~!*()%+@$#[]' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def first_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, row, first): for each record that revisits another, the id of that one."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").alias("id"), F.sha1(body).alias("sha"), F.length(body).alias("n"), F.col("url").alias("url")
    ).where(F.col("id").isNotNull() & (F.col("n") >= min_bytes))
    least = rows.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    # written, so that the join can split the records of a payload that very many share
    least = materialize(least.select("sha", "n", "first"), "warc-firsts")
    later = rows.join(least, ["sha", "n"]).where("id <> first")
    return later.select("id", "sha", "first").distinct()


def write_archives(
    pages: DataFrame, min_bytes: int = 0, where: str | None = None, captured_col: str | None = None
) -> DataFrame:
    """(archive, records): the archives written, one or more for each task.

    captured_col names a column of capture times, a timestamp or text that reads as one.
    """
    spark = pages.sparkSession
    importable(spark)
    where = where or new_path(spark, "warc")
    when = F.lit(None).cast("string")
    if captured_col is not None:
        when = F.date_format(F.try_to_timestamp(F.col(captured_col).cast("string")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = materialize(first_captures(pages, min_bytes), "warc-revisits")
    body = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), when.alias("captured"), body.alias("html"))
    marked = src.withColumn("sha0", F.sha1(F.col("html").cast("binary"))).join(
        broadcast_if_small(later.withColumnRenamed("sha", "sha0").withColumnRenamed("id", "page_id")), ["page_id", "sha0"], "left"
    )
    marked = marked.select("page_id", "url", "captured", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, count = None, "", 0
        for b in batches:
            for page_id, url, captured, text, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{where}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = _open(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, count = fs.open_output_stream(path, compression=None), 0
                date = captured or (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                rec = _record(page_id, url if url is not None else "about:blank", date, text.encode("utf-8", "replace"), first)
                out.write(gzip.compress(rec, 1, mtime=0))
                count += 1
                if count >= RUN_LINES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"archive": name, "records": count}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": count}])

    return materialize(marked.mapInArrow(run, "archive string, records long"), "warc-archives")


def read_archive(uri: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, WARC headers, block) of every record; one record is held at a time."""
    fs, path = _open(uri)
    with fs.open_input_stream(path, compression=None) as f:
        offset, buf = 0, b""
        while True:
            if not buf:
                buf = f.read(1 << 20)
                if not buf:
                    return
            d, parts, used = zlib.decompressobj(31), [], 0
            while not d.eof:
                if not buf:
                    buf = f.read(1 << 20)
                    if not buf:
                        raise EOFError(f"{uri} ends within a record")
                parts.append(d.decompress(buf))
                used += len(buf) - len(d.unused_data)
                buf = d.unused_data
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            yield offset, fields, rest[: int(fields["Content-Length"])]
            offset += used


def index_line(uri: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    """(urlkey, captured, page_id, bytes, digest, type, refers_to, archive, offset) of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"damaged record at {offset} of {uri}")
    ident = lambda k: fields[k][10:-1] if k in fields else ""
    page = ident("WARC-Record-ID")
    refers = ident("WARC-Refers-To")
    return (
        url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], int(page) if page else None, size, digest, kind,
        int(refers) if refers else None, uri, offset,
    )


def _order(row: tuple) -> tuple:
    return row[0], row[1], -(2**63) if row[2] is None else row[2], row[7], row[8]


def _line(row: tuple) -> bytes:
    return "\t".join("" if v is None else str(v) for v in row).encode() + b"\n"


def _row(line: bytes) -> tuple:
    p = line.decode().rstrip("\n").split("\t")
    num = lambda s: int(s) if s else None
    return p[0], p[1], num(p[2]), int(p[3]), p[4], p[5], num(p[6]), p[7], int(p[8])


class LoserTree:
    """Merges sorted iterators: each node keeps the loser of its match, the winner goes up."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads: list[tuple | None] = [self._next(i) for i in range(len(sources))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _next(self, i: int) -> tuple | None:
        row = next(self.sources[i], None)
        return None if row is None else (_order(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, i: int) -> None:
        """Source i goes up from its leaf; it stops where no opponent has come yet."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while True:
            i = self.losers[0]
            head = self.heads[i] if i >= 0 else None
            if head is None:
                return
            yield head[1]
            self.heads[i] = self._next(i)
            self._play(i)


def _slice(uri: str, lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """Rows of a sorted run from lo on and before hi; the start is found by binary search."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        a, b = 0, f.size()
        if lo is not None:
            # least offset behind which a line starts that is not below lo
            while a < b:
                mid = (a + b) // 2
                line = _first_line(f, mid)
                if line is None or _order(_row(line[1])) >= lo:
                    b = mid
                else:
                    a = line[0] + len(line[1]) if line[0] + len(line[1]) > mid else mid + 1
            start = _first_line(f, a)
            if start is None:
                return
            f.seek(start[0])
        buf = b""
        while True:
            more = f.read(1 << 18)
            buf += more
            *lines, buf = buf.split(b"\n")
            for x in lines:
                row = _row(x)
                if hi is not None and _order(row) >= hi:
                    return
                yield row
            if not more:
                return


def _first_line(f, at: int) -> tuple[int, bytes] | None:
    """The first whole line that starts at or after offset at, and where it starts."""
    start = at
    if at > 0:
        f.seek(at - 1)
        skip = b""
        while b"\n" not in skip:
            more = f.read(4096)
            if not more:
                return None
            skip += more
        start = at - 1 + skip.index(b"\n") + 1
    f.seek(start)
    line = b""
    while b"\n" not in line:
        more = f.read(4096)
        if not more:
            return None
        line += more
    return start, line[: line.index(b"\n") + 1]


def index_runs(archives: DataFrame, where: str | None = None) -> DataFrame:
    """(run, lines, keys): sorted runs of the index lines of the archives, and sampled lines."""
    spark = archives.sparkSession
    importable(spark)
    where = where or new_path(spark, "cdx")
    per_run = max(1, min(64, SAMPLE_KEYS // max(1, archives.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = sorted((index_line(uri, *r) for r in read_archive(uri)), key=_order)
                name = f"{where}/{uuid.uuid4().hex}.cdx"
                _write_run(name, iter(rows))
                step = max(1, len(rows) // per_run)
                keys = [_line(r) for r in rows[step // 2 :: step]][:per_run]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([keys], pa.list_(pa.binary()))],
                    names=["run", "lines", "keys"],
                )

    n = max(1, archives.count())
    # an archive for each task, as far as hashing allows
    return materialize(archives.select("archive").repartition(n, "archive").mapInArrow(run, "run string, lines long, keys array<binary>"), "cdx-runs")


def _write_run(name: str, rows: Iterator[tuple]) -> int:
    fs, path = _open(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(path, compression=None) as f:
        held: list[bytes] = []
        for r in rows:
            held.append(_line(r))
            n += 1
            if len(held) >= 10_000:
                f.write(b"".join(held))
                held = []
        f.write(b"".join(held))
    return n


def _keys(runs: DataFrame) -> list[tuple]:
    """Sampled order keys of the runs, sorted: some SAMPLE_KEYS at most, whatever the input."""
    n = runs.count()
    rows = runs if n <= SAMPLE_KEYS else runs.orderBy(F.xxhash64("run")).limit(SAMPLE_KEYS)
    return sorted(_order(_row(bytes(k))) for r in rows.select("keys").collect() for k in r["keys"])


def _edge(keys: list[tuple], i: int, ranges: int) -> tuple | None:
    """Lower bound of range i; where a range is split, its first part starts at the same key."""
    return keys[len(keys) * i // ranges] if keys and 0 < i < ranges else None


def _split(parts: DataFrame, by: list[str], times: int) -> DataFrame:
    """A row (by..., names, into) for each of times equal shares of the range r."""
    rows = parts.groupBy(*by).agg(F.collect_list("name").alias("names"))
    return rows.withColumn("into", F.explode(F.expr(f"sequence(r * {times}L, r * {times}L + {times - 1}L)")))


def merge_runs(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """COLUMNS plus range and place: captures in global order of range, then place.

    While there are more than FAN_IN runs, groups of them become one run each.  A level
    is split by ranges too: a merged run is a file for each range, and each level has
    FAN_IN times the ranges of the one before, so a task always writes about as many
    lines as a first run has.
    """
    importable(spark)
    total = runs.agg(F.sum("lines").alias("n"), F.count("*").alias("c")).first()
    lines, count, ranges = total["n"] or 0, total["c"], 1
    keys = _keys(runs)
    parts = runs.select("run", F.lit(0).cast("long").alias("r"), F.col("run").alias("name"))
    while count > FAN_IN:
        where = new_path(spark, "cdx")
        groups, ranges = -(-count // FAN_IN), ranges * FAN_IN
        jobs = _split(parts.withColumn("g", F.pmod(F.xxhash64("run"), F.lit(groups))), ["g", "r"], FAN_IN)

        def level(batches: Iterator[pa.RecordBatch], where=where, ranges=ranges) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, i, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    name = f"{where}/{uuid.uuid4().hex}.cdx"
                    lo, hi = _edge(keys, i, ranges), _edge(keys, i + 1, ranges)
                    n = 0 if lo is not None and lo == hi else _write_run(name, iter(LoserTree([_slice(x, lo, hi) for x in names])))
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(g)]), pa.array([i], pa.int64()), pa.array([name])], names=["run", "r", "name"]
                        )

        todo = jobs.select("g", "into", "names").repartition(groups * FAN_IN, "g", "into")
        parts = materialize(todo.mapInArrow(level, "run string, r long, name string"), "cdx-parts")
        count = groups
    times = max(1, min(-(-lines // (ranges * RANGE_LINES)), max(1, 10_000 // ranges)))
    ranges *= times
    jobs = _split(parts, ["r"], times).select("into", "names").repartition(max(1, min(ranges, 10_000)), "into")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in COLUMNS.split(", ")]
        for b in batches:
            for i, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lo, hi = _edge(keys, i, ranges), _edge(keys, i + 1, ranges)
                if lo is not None and lo == hi:
                    continue
                held: list[tuple] = []
                place = 0

                def out(held=held, i=i) -> pa.RecordBatch:
                    cols = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
                    n = len(held)
                    return pa.RecordBatch.from_arrays(
                        [*cols, pa.array([i] * n, pa.int64()), pa.array(range(place - n, place), pa.int64())],
                        names=[*fields, "range", "place"],
                    )

                for row in LoserTree([_slice(x, lo, hi) for x in names]):
                    held.append(row)
                    place += 1
                    if len(held) >= 5000:
                        yield out()
                        held.clear()
                if held:
                    yield out()

    return jobs.mapInArrow(merge, COLUMNS + ", range long, place long")


def capture_histories(pages: DataFrame, min_bytes: int = 0, captured_col: str | None = None) -> DataFrame:
    """Write pages to archives, read them back and merge their indexes."""
    return merge_runs(pages.sparkSession, index_runs(write_archives(pages, min_bytes, captured_col=captured_col)))
