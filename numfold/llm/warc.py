"""WARC archives with a two-level capture index.

Writing: every page becomes one record, each its own gzip member, after a warcinfo record.
Of pages with equal payloads (SHA-1) of at least `least` bytes the one with the largest
page_id is a response and the others are revisits of it. Files go to the shared folder, one
per task attempt under a name of its own; captures name the file of the attempt that Spark
took, so a repeated or speculative task never changes what offsets point to.

Index: captures are sorted by reversed-host URL key and page_id by range partitioning.
Each shard file holds compressed blocks of LINES captures and, at its end, a directory of
the blocks' first keys. One file of the same form, the top, lists the shards (one line for
about SHARD captures). A reader gets the place of the top's directory alone; it
binary-searches that directory, reads one block of the top, then does the same in a shard,
finds the captures and reads their records' ranges. Nothing that grows is sent or collected.

Defined results: a null html is an empty payload; a null page_id is a response of its
own; a null URL stands as `urn:unknown:`; repeated rows with one page_id and payload are
responses each and share a record id; empty tables give empty archives. Long payloads are
written whole. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

LINES, SHARD, TASK = 500, 200_000, 5_000
BROADCAST_IDS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:numfold:page")
LINE = "key string, file string, begin long, size long"


def surt(url: str | None) -> str:
    """Reversed-host key: 'https://a.example.com/x?y' gives 'com,example,a)/x?y'."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")/" + "".join(url.split())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return "".join((key + (f"?{parts.query}" if parts.query else "")).split())


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of a capture; ids sort by value."""
    return f"{surt(url)} {'-' if page_id is None else format(page_id + 2**63, '020d')}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def member(lines: list[str], block: bytes) -> bytes:
    """One record as a gzip member."""
    out = zlib.compressobj(3, zlib.DEFLATED, 31)
    head = "\r\n".join(["WARC/1.1", *lines, f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"])
    return out.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def info() -> bytes:
    return member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "Content-Type: application/warc-fields"], b"software: numfold\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url) if url else "urn:unknown:"
    lines = [
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page-ID: {refers}"] if refers is not None else []),
        "Content-Type: application/http; msgtype=response",
    ]
    return member(lines, http + (payload if refers is None else b""))


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Sink:
    """A file in the shared folder that gets its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Ranges:
    """Range reads from a few files kept open."""

    def __init__(self, root: str, most: int = 32):
        self.root, self.most, self.open = root, most, {}

    def file(self, name: str):
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = fs.FileSystem.from_uri(f"{self.root}/{name}")
            self.open[name] = system.open_input_file(path)
        return self.open[name]

    def read(self, name: str, begin: int, size: int) -> bytes:
        return self.file(name).read_at(size, begin)


def revisits(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(page_id, sha, refers) of pages whose payload a page with a larger id holds as well."""
    ids = pages.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))
    last = scratch.keep(ids.groupBy("sha").agg(F.max("page_id").alias("refers"), F.min("page_id").alias("low")).where("low < refers").drop("low"))
    return scratch.keep(ids.join(last, "sha").where("page_id < refers").select("page_id", "sha", "refers").distinct())


def write(pages: DataFrame, root: str, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes archives under `root`; returns captures (key, file, begin, size)."""
    again = revisits(pages, least, scratch)
    small = again.count() <= BROADCAST_IDS  # about 70 bytes each; beyond, a shuffled join
    joined = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(F.broadcast(again) if small else again, ["page_id", "sha"], "left")

    def run(batches):
        name = f"warc/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink = None
        for batch in batches:
            keys, begins, sizes = [], [], []
            for page_id, url, html, sha, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    sink = Sink(f"{root}/{name}")
                    sink.write(info())
                data = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), refers)
                keys.append(capture_key(url, page_id))
                begins.append(sink.write(data))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())], ["key", "file", "begin", "size"])
        if sink:
            sink.close()

    return scratch.keep(joined.select("page_id", "url", "html", "sha", "refers").mapInArrow(run, LINE))


def write_level(lines: DataFrame, folder: str, parts: int, root: str, scratch: Scratch) -> DataFrame:
    """Writes sorted lines (key, file, begin, size) to `parts` files of blocks; returns one such line for each file: its first key, and the place and size of its directory."""

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        sink, held, directory = None, [], []

        def flush():
            data = zlib.compress("\n".join(held).encode(), 6)
            directory.append(f"{held[0].split(chr(9))[0]}\t{name}\t{sink.write(data)}\t{len(data)}")
            held.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sink = sink or Sink(f"{root}/{name}")
                held.append("\t".join(map(str, line)))
                if len(held) == LINES:
                    flush()
        if sink:
            if held:
                flush()
            data = zlib.compress("\n".join(directory).encode(), 6)
            at = sink.write(data)
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], ["key", "file", "begin", "size"])

    return scratch.keep(lines.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "begin").mapInArrow(run, LINE))


def build_index(captures: DataFrame, root: str, scratch: Scratch) -> tuple[str, int, int] | None:
    """Writes the shards and the top; returns the place of the top's directory, None without captures."""
    shards = write_level(captures, "cdx", max(1, math.ceil(captures.count() / SHARD)), root, scratch)
    top = write_level(shards, "top", 1, root, scratch).first()
    return tuple(top)[1:] if top else None


class Index:
    """Reader of the two levels."""

    def __init__(self, root: str, top: tuple[str, int, int] | None):
        self.files, self.top = Ranges(root), top
        self.read: dict[tuple, tuple] = {}

    def lines(self, place: tuple[str, int, int]) -> tuple[list[str], list[tuple[str, int, int]]]:
        """Keys and places of a block or directory; some are kept."""
        if place not in self.read:
            if len(self.read) > 128:
                self.read.clear()
            rows = [x.split("\t") for x in zlib.decompress(self.files.read(*place)).decode().split("\n")]
            self.read[place] = [r[0] for r in rows], [(r[1], int(r[2]), int(r[3])) for r in rows]
        return self.read[place]

    def upto(self, place: tuple[str, int, int], key: str):
        """Lines (key, place) of a block from the last one below `key` through those equal to it."""
        keys, places = self.lines(place)
        at = max(0, bisect_left(keys, key) - 1)
        while at < len(keys) and keys[at] <= key:
            yield keys[at], places[at]
            at += 1

    def find(self, key: str):
        """Captures (file, begin, size) of a key, which may run on over blocks and shards."""
        if self.top is None:
            return
        shards = (shard for _, block in self.upto(self.top, key) for _, shard in self.upto(block, key))
        seen = set()
        for shard in shards:
            if shard in seen:
                continue
            seen.add(shard)
            for _, block in self.upto(shard, key):
                for found, place in self.upto(block, key):
                    if found == key:
                        yield place


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(wanted: DataFrame, root: str, top: tuple[str, int, int] | None, tasks: int) -> DataFrame:
    """Records of the captures of (url, page_id) rows, each found by the index and read by range."""

    def key_rows(batch: pa.RecordBatch):
        keys = [capture_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    keys = arrow_map(wanted.select("url", "page_id"), key_rows, "key string").distinct()

    def number(digits: str) -> int | None:
        return int(digits) if digits else None

    def run(batches):
        index, archives = Index(root, top), Ranges(root)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for name, begin, size in index.find(key):
                    fields, http, payload = parse(archives.read(name, begin, size))
                    page_id, digest = number(fields["X-Page-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of page {page_id} does not match its digest")
                        rows.append((page_id, len(payload), digest, "response", None))
                    else:
                        rows.append((page_id, int(http["Content-Length"]), digest, "revisit", number(fields["X-Refers-To-Page-ID"])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [x.split()[0] for x in ROWS.split(", ")])

    # neighbouring keys meet in a task, so each block and directory is read a few times only
    return keys.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, ROWS)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, builds the index, and reads every record back through it."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    scratch = Scratch(pages.sparkSession, "warc")
    captures = write(pages, scratch.root, scratch, least)
    return read_back(pages, scratch.root, build_index(captures, scratch.root, scratch), max(1, math.ceil(captures.count() / TASK)))
