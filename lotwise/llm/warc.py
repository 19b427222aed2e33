"""Operator 6, WARC archives and the external merge of their capture index.

Records are gzip members, gathered into archives of some megabytes; an archive is a row with a binary column, so that
Spark's own committed writers store it wherever the cluster's files are. A payload that another record has too is
written once, as the response of the largest page_id; the others are revisit records that refer to it.

Reading back parses every member, checks each digest and gives an index entry per record. The index is merged
externally: every task sorts its captures by URL key, timestamp and page_id into a run, cuts the run at the borders of
key ranges and packs it into blocks. A range's blocks meet in one task, where a loser tree merges the runs, so that the
ranges, one after the other, hold all capture histories in order. Borders come from a bounded sample of the whole key
(URL key, timestamp, page_id), so that a URL with very many captures spreads over many ranges; a sample decides the
sizes of the ranges, never the order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tables import joined, written

ARCHIVE_BYTES, RANGE_ROWS, BLOCK_ROWS, SAMPLE, PIECE = 4 << 20, 50_000, 4096, 20_000, 1 << 14
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
EPOCH = 1577836800


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """A sort-friendly URL key: host labels reversed, no scheme, www, port, fragment or trailing slash, lower case."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + ")" + (parts.path.rstrip("/") or "/") + ("?" + query if query else "")).lower()


def stamp(seconds: int) -> str:
    """WARC-Date of a number of seconds since 1970, also outside the years that datetime has: days to a civil date by
    eras of 400 years, a published algorithm whose numbers are fixed values."""
    days, rest = divmod(seconds, 86400)
    z = days + 719468
    era, doe = z // 146097, z % 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    year = yoe + 400 * era + (month <= 2)
    return f"{year:04d}-{month:02d}-{doy - (153 * mp + 2) // 5 + 1:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}Z"


def record(page: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One record as a gzip member; a revisit of the page ``original``, or a response if that is None."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if original is None else b"")
    target = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {stamp(EPOCH + (page or 0))}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(body)}"]
    if original is not None:
        fields += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {IDENTICAL}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; the archive is fed in pieces, so that its length costs nothing."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        unpack, parts, place = zlib.decompressobj(31), [], at
        while not unpack.eof and place < len(view):
            piece = view[place : place + PIECE]
            parts.append(unpack.decompress(piece))
            place += len(piece)
        if not unpack.eof:
            raise ValueError(f"the gzip member at {at} is cut off")
        end = place - len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields (names in lower case), HTTP fields and payload of a record, with its digests checked."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    head, _, rest = content.partition(b"\r\n\r\n")
    warc = fields(head)
    body = rest[: int(warc["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n" or digest(body) != warc["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"the record {warc.get('warc-record-id')} is damaged")
    http, _, payload = body.partition(b"\r\n\r\n")
    if warc["warc-type"] == "response" and digest(payload) != warc["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"the payload of {warc.get('warc-record-id')} is damaged")
    return warc, fields(http), payload


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, data): archives with a record for each row of pages(page_id, url, html); a null html is empty.

    Equal payloads of at least min_bytes bytes are one response, at the largest page_id, and revisits of it. Rows with
    this same page_id are responses as well, and so is a row without page_id; neither is referred to twice.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], ["page_id", "sha", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, bytearray()
        for batch in batches:
            for page, url, html, original in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist(), strict=True):
                held += record(page, url, html.as_py() or b"", original)
                if len(held) >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc.gz"]), pa.array([bytes(held)])], ["archive", "data"])
                    n, held = n + 1, bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc.gz"]), pa.array([bytes(held)])], ["archive", "data"])

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    found = written(own.select("page_id", "html").mapInArrow(sums, "page_id bigint, sha binary, size bigint").filter(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)), "warc-digests")
    largest = written(found.groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n_rows")).filter("n_rows > 1"), "warc-largest")
    # A page_id may stand on several rows: what a row revisits hangs on its payload too.
    again = joined(found, largest, ["sha"], found.count()).filter("page_id < original").select("page_id", "sha", "original").distinct()
    own = own.join(again.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))) == F.col("sha")), "left")
    return own.select("page_id", "url", "html", "original").mapInArrow(run, "archive string, data binary")


ENTRY = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string, url string, archive string, offset bigint, length bigint"
FIELDS = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in (x.split() for x in ENTRY.split(", "))])


def read_archives(archives: DataFrame) -> DataFrame:
    """An index entry for each record of archives(archive, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, size, content in members(data.as_py()):
                    warc, http, payload = parse(content)
                    n = len(payload) if warc["warc-type"] == "response" else int(http["content-length"])
                    rows.append((number(warc["warc-record-id"]), n, warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], number(warc.get("warc-refers-to")), url_key(warc["warc-target-uri"]), warc["warc-date"], warc["warc-target-uri"], name, at, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)

    return archives.select("archive", "data").mapInArrow(run, ENTRY)


class LoserTree:
    """A tournament of sorted streams: the winner on top, at each inner node the loser of its match."""

    END = ("\U0010ffff" * 2,)

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams, self.k = streams, max(1, len(streams))
        self.heads = [next(s, None) for s in streams] or [None]
        self.losers = [-1] * self.k
        self.winner = self.play(1)

    def less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        won, lost = (a, b) if self.less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while (top := self.heads[self.winner]) is not None:
            yield top
            now = self.winner
            self.heads[now] = next(self.streams[now], None)
            node = (now + self.k) // 2
            while node:
                if self.less(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def order_of(row: dict) -> tuple:
    """By URL key and time. Times are compared as numbers: a capture is page_id seconds after 2020, and as text a year of
    five digits or before year 0 would stand in the wrong place."""
    return row["url_key"], row["page_id"] or 0, row["page_id"] is not None, row["archive"], row["offset"]


def merged_index(entries: DataFrame, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """entries with ``place``, their position in the whole order by URL key, timestamp and page_id, from 0 without
    gaps, and ``capture``, the number of the capture in its URL key's history, from 0."""
    # Ranges are few beside the sample that parts them; in very large tables they grow instead, and are merged as streams.
    n_ranges = min(max(1, -(-entries.count() // range_rows)), SAMPLE // 8)
    key = ["url_key", "page_id", "archive", "offset"]
    sample = entries.select(*key).orderBy(F.xxhash64("page_id", "archive", "offset")).limit(SAMPLE).collect() if n_ranges > 1 else []
    sample = sorted(order_of(r.asDict()) for r in sample)
    borders = [sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)] if sample else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for number, table in enumerate(gathered(batches, 4 * range_rows)):
            rows = table.to_pylist()
            keys = [order_of(r) for r in rows]
            order = sorted(range(len(rows)), key=keys.__getitem__)
            table, keys = table.take(pa.array(order)), [keys[i] for i in order]
            cuts = [0, *(bisect.bisect_left(keys, b) for b in borders), len(keys)]
            out = [(r, f"{run:06d}-{number:06d}", i, min(block_rows, b - i), packed(table.slice(i, min(block_rows, b - i)))) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) for i in range(a, b, block_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "run", "first", "n", "block"])

    def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= limit:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def stream(blocks: list[bytes]) -> Iterator[tuple]:
        for block in blocks:
            for row in pa.ipc.open_stream(block).read_all().to_pylist():
                yield order_of(row), row

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            rows, place = [], 0
            for _, row in LoserTree([stream(b) for b in held.values()]):
                rows.append(row | {"range": now, "inside": place})
                place += 1
                if len(rows) == block_rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        schema = FIELDS.append(pa.field("range", pa.int32())).append(pa.field("inside", pa.int64()))
        for batch in batches:
            for r, run, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != now:
                    if held:
                        yield from done()
                    now, held = r, {}
                held.setdefault(run, []).append(block)
        if held:
            yield from done()

    blocks = written(entries.mapInArrow(runs, "range int, run string, first bigint, n bigint, block binary"), "warc-runs")
    sizes = {r["range"]: r["n"] for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for r in range(n_ranges):
        starts.append((r, at))
        at += sizes.get(r, 0)
    ordered = blocks.select("range", "run", "block", "first").repartition(n_ranges, "range").sortWithinPartitions("range", "run", "first").select("range", "run", "block").mapInArrow(merge, f"{ENTRY}, range int, inside bigint")
    ordered = written(ordered, "warc-index")
    starts = F.broadcast(entries.sparkSession.createDataFrame(starts, "range int, start bigint"))
    placed = ordered.join(starts, "range").withColumn("place", F.col("start") + F.col("inside")).drop("range", "start", "inside")
    first = written(placed.groupBy("url_key").agg(F.min("place").alias("_first"), F.count("*").alias("n_rows")), "warc-first")
    return joined(placed, first, ["url_key"], at).withColumn("capture", F.col("place") - F.col("_first")).drop("_first", "n_rows")


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives, reads these back and merges their index: merged_index() of all records.

    Null URLs count as ''; null html as empty. A page's capture time is page_id seconds after 2020-01-01. An empty
    table gives no rows; other columns of pages play no part.
    """
    archives = written(write_archives(pages, min_bytes), "warc-archives")
    return merged_index(written(read_archives(archives), "warc-entries"))
