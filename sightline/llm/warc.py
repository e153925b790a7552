"""WARC archives of page captures and their merged capture index.

*Write.* Every page becomes one record of a gzip-member-per-record WARC/1.1 archive in shared storage: the first (smallest
page_id) of records with equal payloads of at least ``REVISIT_BYTES`` bytes is a response, the others are revisits of it. Which
that is comes from an aggregation by payload digest; digests with more than ``HEAVY_SHARE`` of all records, at most 1 / HEAVY_SHARE of them,
are looked up by broadcast, the rest by an ordinary shuffle. A task writes files under names of its own and returns them as manifest rows;
only the files of the written manifest count, so that the files of lost or repeated tasks are never read.

*Read.* Archives are read back record by record; a response whose payload does not hash to its digest stops the job.

*Index.* The records of an archive are sorted by URL key, time and page_id into runs of at most ``RUN`` records. Split points from a
bounded sample of keys cut the key space into ranges, and runs into chunks; chunks go to the partition of their range, and a loser
tree merges the chunks of all runs there, opened in the order of their first keys. Ranges with their positions are a globally
ordered capture history. A hot URL is no hot key, since time and page_id are part of the key.

Defined results: null html is an empty payload; null URLs have an empty key and no target header; null page_ids rank last, never are what
others refer to, and are responses where a payload occurs only with them; rows that repeat page_id and payload are one capture,
all of the same type; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import HEAVY_SHARE, columns_of, partitions
from sightline.session import cut, new_path

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
RUN = 50_000
CHUNK_ROWS = 512
SAMPLE = 4096
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = pa.schema([
    ("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
])
_ENTRY_DDL = (
    "url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, archive string, offset long"
)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query; scheme, www, port, user and fragment left out."""
    found = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not found:
        return (url or "").split("#")[0]
    host = found[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/")


def _store(folder: str):
    """File system and path of a folder URI, whatever store it is in."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, time: str) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {time}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _store(folder)
        files.create_dir(path, recursive=True)
        stream, name, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "digest", "refers_to"))
                if stream is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = files.open_output_stream(f"{path}/{name}", compression=None)
                time = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                raw = gzip.compress(record(page_id, url, html.encode(), digest, refers_to, time), 4, mtime=0)
                stream.write(raw)
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; returns the manifest: archive, records, bytes."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long_ = F.octet_length("html") >= REVISIT_BYTES
    total, groups = rows.count(), rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and first is not null"), "payloads")
    heavy = F.broadcast(groups.where(F.col("n") > total * HEAVY_SHARE).select("digest", F.col("first").alias("heavy")))
    light = groups.where(F.col("n") <= total * HEAVY_SHARE).select("digest", "first")
    rows = rows.join(heavy, "digest", "left")
    other = rows.where("heavy is null").join(light, "digest", "left").select("page_id", "url", "html", "digest", "first")
    rows = rows.where("heavy is not null").select("page_id", "url", "html", "digest", F.col("heavy").alias("first")).unionByName(other)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return cut(rows.mapInArrow(_writer(folder), "archive string, records long, bytes long"), "manifest")


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a stream."""
    held, offset = b"", 0
    while True:
        held = held or stream.read(size)
        if not held:
            return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            held = held or stream.read(size)
            if not held:
                raise ValueError("archive ends within a record")
            parts.append(inflate.decompress(held))
            used += len(held)
            held = inflate.unused_data if inflate.eof else b""
        used -= len(held)
        yield offset, b"".join(parts)
        offset += used


def parse(raw: bytes) -> dict:
    """Headers, payload and HTTP length of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "payload": payload, "length": length}


def _urn(value: str | None) -> int | None:
    name = (value or "<urn:page:None>")[len("<urn:page:") : -1]
    return None if name == "None" else int(name)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of each archive as sorted runs, one after another; ``run`` names them."""

    def entries(files, path: str, archive: str) -> Iterator[tuple]:
        with files.open_input_stream(f"{path}/{archive}", compression=None) as stream:
            for offset, raw in members(stream):
                found = parse(raw)
                headers, kind = found["headers"], found["headers"]["WARC-Type"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (len(found["payload"]) != found["length"] or hashlib.sha256(found["payload"]).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                yield (
                    url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], _urn(headers["WARC-Record-ID"]), found["length"], digest, kind,
                    _urn(headers.get("WARC-Refers-To")), archive, offset,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _store(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                held: list[tuple] = []
                at = 0
                for entry in entries(files, path, archive):
                    held.append(entry)
                    if len(held) == RUN:
                        yield _rows(held, f"{archive}:{at}")
                        held, at = [], at + 1
                if held:
                    yield _rows(held, f"{archive}:{at}")

    def _rows(held: list[tuple], name: str) -> pa.RecordBatch:
        held.sort(key=_order)
        columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), _ENTRY.types, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(held))], names=[*_ENTRY.names, "run"])

    return run


def read_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Sorted runs of index entries of the archives, as a written table."""
    files = manifest.select("archive").repartition(max(1, min(manifest.count(), 4 * partitions(manifest.sparkSession))))
    return cut(files.mapInArrow(_reader(folder), _ENTRY_DDL + ", run string"), "runs")


class LoserTree:
    """Tournament of sorted sources: inner nodes keep the loser of their match, so a new winner takes one path.

    Sources may come while the tree runs; when no leaf is free their number doubles.
    """

    def __init__(self) -> None:
        self.leaves: list = [None]  # iterator, or None
        self.heads: list = [None]  # next (key, value), or None
        self.losers: list[int] = []
        self.winner = 0
        self.free = [0]

    def _wins(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _build(self) -> None:
        n = len(self.leaves)
        self.losers = [0] * n
        best = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.winner = best[1] if n > 1 else 0

    def add(self, source: Iterator[tuple]) -> None:
        if not self.free:
            n = len(self.leaves)
            self.free = list(range(2 * n - 1, n - 1, -1))
            self.leaves += [None] * n
            self.heads += [None] * n
        leaf = self.free.pop()
        self.leaves[leaf], self.heads[leaf] = source, next(source, None)
        self._build()

    def peek(self) -> tuple | None:
        return self.heads[self.winner]

    def pop(self) -> tuple:
        leaf = self.winner
        out, self.heads[leaf] = self.heads[leaf], next(self.leaves[leaf], None)
        if self.heads[leaf] is None:
            self.leaves[leaf] = None
            self.free.append(leaf)
        node = (leaf + len(self.leaves)) // 2
        while node:
            if self._wins(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node //= 2
        self.winner = leaf
        return out


def _chunked(splits: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of runs that lie within one range, each packed as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_order(x) for x in zip(*(batch.column(c).to_pylist() for c in _ENTRY.names[:3]), strict=True)]
            names = batch.column("run").to_pylist()
            part = [bisect_right(splits, k) for k in keys]
            body, rows, a = batch.select(_ENTRY.names), [], 0
            for b in range(1, len(keys) + 1):
                if b < len(keys) and b - a < CHUNK_ROWS and part[b] == part[a] and names[b] == names[a]:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ENTRY) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([body.column(i).slice(a, b - a).cast(t) for i, t in enumerate(_ENTRY.types)], schema=_ENTRY))
                rows.append((part[a], keys[a][0], keys[a][1], keys[a][2], keys[a][3], sink.getvalue().to_pybytes()))
                a = b
            if rows:
                columns = ("history_range", "head_url", "head_time", "head_null", "head_id", "body")
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the chunks of each range. They come sorted by range and first key."""

    def opened(body: bytes) -> Iterator[tuple]:
        rows = zip(*(c.to_pylist() for c in pa.ipc.open_stream(body).read_all().columns), strict=True)
        return ((_order(x), x) for x in rows)

    def chunks() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in ("history_range", "head_url", "head_time", "head_null", "head_id", "body")]
            for row in range(batch.num_rows):
                part, *head, body = (c[row].as_py() for c in columns)
                yield part, tuple(head), body

    def packed(part: int, at: int, out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _ENTRY.types, strict=True)]
        place = [pa.array([part] * len(out), pa.int64()), pa.array(range(at, at + len(out)), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *place], names=[*_ENTRY.names, "history_range", "history_position"])

    source = chunks()
    ahead = next(source, None)
    while ahead is not None:
        part, tree, at, out = ahead[0], LoserTree(), 0, []
        while True:
            first = tree.peek()
            while ahead is not None and ahead[0] == part and (first is None or ahead[1] <= first[0]):
                tree.add(opened(ahead[2]))
                ahead, first = next(source, None), tree.peek()
            if first is None:
                break
            out.append(tree.pop()[1])
            if len(out) == 4096:
                yield packed(part, at, out)
                at, out = at + len(out), []
        if out:
            yield packed(part, at, out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Index entries in global order: by history_range, and in it by history_position."""
    n = partitions(runs.sparkSession)
    key = F.xxhash64("url_key", "capture_time", "page_id")
    sample = sorted(_order(tuple(r)) for r in runs.select(*_ENTRY.names[:3]).orderBy(key).limit(SAMPLE).collect())
    ranges = min(4 * n, max(1, len(sample) // 4))
    splits = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
    ddl = "history_range long, head_url string, head_time string, head_null boolean, head_id long, body binary"
    chunks = cut(runs.mapInArrow(_chunked(splits), ddl), "chunks")
    placed = chunks.repartitionByRange(n, "history_range").sortWithinPartitions("history_range", "head_url", "head_time", "head_null", "head_id")
    return placed.mapInArrow(_merged, _ENTRY_DDL + ", history_range long, history_position long")


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives, reads them back and merges their indexes: one row per page in the order of its history."""
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write_archives(columns_of(pages, page_id=id_col, url=url_col, html=html_col), folder)
    return merge_runs(read_runs(manifest, folder))
