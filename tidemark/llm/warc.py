"""WARC archives with a two-level capture index.

Writing: each task streams its pages into archive files in the shared folder,
one gzip member per record, and returns a capture row (key, file, offset,
length) for each. File names are unique to the attempt, so a retried task
leaves at most an unreferenced file. Payloads that occur again become revisit
records of the first.

Index: captures sorted by reversed-host URL key are cut into compressed blocks;
a shard file ends with its sparse directory, the first and last key of every
block. Lookup: binary search among the shards' key ranges, then in the shard's
directory, then in the block; only the block and the record are read, by range.

A hot URL has captures in many blocks and shards, since captures are ordered by
key and page. So the blocks that a key may be in are found first, a row for each,
and dealt out anew before they are read; record reads are dealt out by file and
offset.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from bisect import bisect_left
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import create, new_path, opened, written

BLOCK_LINES = 3_000
ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURES = "key string, page string, kind string, digest string, file string, at long, size long"
_RECORDS = "page string, url string, kind string, payload_bytes long, digest string, stated_digest string, refers string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """Reversed-host key in printable ASCII: ``http://a.example.com/x?y`` gives ``com,example,a)/x?y``."""
    url = url or ""
    try:
        parts = urllib.parse.urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        host = ""
    if not host:
        return urllib.parse.quote(url, safe="!$&'()*+,-./:;=?@_~%")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return urllib.parse.quote(",".join(reversed(host.split("."))) + port + ")" + rest, safe="!$&'()*+,-./:;=?@_~%")


class _Ranges:
    """Range reads of one file, with read-ahead for reads that follow each other."""

    def __init__(self, uri: str, ahead: int = READ_BYTES):
        self.file, self.ahead, self.at, self.held = opened(uri), ahead, 0, b""
        self.size = self.file.size()

    def read(self, at: int, size: int) -> bytes:
        if not (self.at <= at and at + size <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(size, self.ahead), self.size - at), at)
        return self.held[at - self.at : at - self.at + size]

    def close(self):
        self.file.close()


# Records


def _gz(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """An uncompressed WARC/1.1 record; ``refers`` is the page whose response a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload

    def record_id(of: str | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{of}/{digest}')}>"

    fields = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page", refers)]
    if page is not None:
        fields.append(("X-Page", page))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields and payload of an uncompressed record; a revisit's length is the one its HTTP head states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page": fields.get("X-Page"),
        "url": fields.get("WARC-Target-URI"),
        "kind": kind,
        "payload_bytes": stated if kind == "revisit" else len(payload),
        "digest": digest if kind == "revisit" else sha1_base32(payload),
        "stated_digest": digest,
        "refers": fields.get("X-Refers-To-Page"),
        "payload": payload,
    }


# Writing


def _archive(batches, folder: str, roll: int):
    out, name, at = None, "", 0
    for batch in batches:
        rows = []
        for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "refers")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = sha1_base32(payload)
            data = _gz(record(page, url, payload, digest, refers))
            if out is None or at >= roll:
                if out is not None:
                    out.close()
                name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                out = create(name)
            out.write(data)
            rows.append((surt(url), page, "revisit" if refers is not None else "response", digest, name, at, len(data)))
            at += len(data)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 5 + [pa.int64()] * 2, strict=True)], ["key", "page", "kind", "digest", "file", "at", "size"])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Captures of the archives written for ``pages`` (page_id, url, html), one row a record.

    Of equal payloads of at least ``min_bytes`` bytes, the smallest page_id is
    the response and the others revisit it. Null html is an empty payload; a
    null url has the empty key; rows without page_id, and repeated rows of the
    smallest one, are responses.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(body, "UTF-8")).alias("hash"), F.octet_length(body).alias("bytes"))
    again = rows.where(F.col("bytes") >= min_bytes).groupBy("hash", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first"))
    marked = rows.join(again, ["hash", "bytes"], "left").select(F.col("page_id").cast("string").alias("page"), "url", "html", F.when(revisits, F.col("first").cast("string")).alias("refers"))
    return written(marked.mapInArrow(partial(_archive, folder=folder, roll=roll), _CAPTURES), "captures")


# Index


def _index_shard(batches, folder: str, lines: int):
    out, name, at, held, directory = None, f"{folder}/{uuid.uuid4().hex}.cdx", 0, [], []

    def flush():
        nonlocal at, held
        data = zlib.compress("\n".join(f"{k} {json.dumps(v)}" for k, v in held).encode(), 6)
        directory.append([held[0][0], held[-1][0], at, len(data), len(held)])
        out.write(data)
        at, held = at + len(data), []

    for batch in batches:
        out = out or create(name)
        columns = ("page", "kind", "digest", "file", "at", "size")
        for key, *entry in zip(*(batch.column(c).to_pylist() for c in ("key", *columns)), strict=True):
            held.append((key, entry))
            if len(held) == lines:
                flush()
    if out is None:
        return
    if held:
        flush()
    if directory:
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data + at.to_bytes(8, "big"))
    out.close()
    if directory:
        yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "last_key": [directory[-1][1]]})


def build_index(captures: DataFrame, lines: int = BLOCK_LINES, shards: int | None = None) -> list[tuple[str, str, str]]:
    """(last key, first key, file) of the index shards in key order.

    Shards are as many as sort partitions; that short list is all that reaches
    the driver.
    """
    spark = captures.sparkSession
    order = ["key", "page", "file", "at"]
    folder = new_path(spark, "capture-index")
    dealt = captures.repartitionByRange(shards, *order) if shards else captures.repartitionByRange(*order)
    made = dealt.sortWithinPartitions(*order).mapInArrow(partial(_index_shard, folder=folder, lines=lines), "file string, first_key string, last_key string")
    return sorted((r["last_key"], r["first_key"], r["file"]) for r in written(made, "index-shards").collect())


class Index:
    """Lookups in the index; one shard's directory and one block are held."""

    def __init__(self, shards: list[tuple[str, str, str]]):
        self.shards, self.last = shards, [s[0] for s in shards]
        self._shard, self._block = (None, None, None, None), (None, None, None)

    def _directory(self, n: int):
        if self._shard[0] != n:
            if self._shard[1] is not None:
                self._shard[1].close()
            source = _Ranges(self.shards[n][2], 0)
            start = int.from_bytes(source.read(source.size - 8, 8), "big")
            directory = json.loads(zlib.decompress(source.read(start, source.size - 8 - start)))
            self._shard = n, source, directory, [d[1] for d in directory]
        return self._shard[1:]

    def _lines(self, n: int, b: int):
        if self._block[0] != (n, b):
            source, directory, _ = self._directory(n)
            text = zlib.decompress(source.read(directory[b][2], directory[b][3])).decode()
            lines = text.split("\n")
            self._block = (n, b), [x.partition(" ")[0] for x in lines], lines
        return self._block[1:]

    def blocks(self, key: str):
        """(shard, block) of every block that may have captures of a key."""
        n = bisect_left(self.last, key)
        while n < len(self.shards) and self.shards[n][1] <= key:
            _, directory, last = self._directory(n)
            b = bisect_left(last, key)
            while b < len(directory) and directory[b][0] <= key:
                yield n, b
                b += 1
            n += 1

    def entries(self, key: str, n: int, b: int):
        """Entries [page, kind, digest, file, at, size] of a key in a block."""
        keys, lines = self._lines(n, b)
        i = bisect_left(keys, key)
        while i < len(keys) and keys[i] == key:
            yield json.loads(lines[i].partition(" ")[2])
            i += 1

    def find(self, key: str):
        """Entries of a key in all blocks."""
        for n, b in self.blocks(key):
            yield from self.entries(key, n, b)


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": [surt(u) for u in batch.column("url").to_pylist()]})


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _in_pieces(rows, names: list[str], types: list, most: int = 8192):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _table(held, names, types)
            held = []
    if held:
        yield _table(held, names, types)


def _blocks(batches, shards):
    index = Index(shards)
    for batch in batches:
        yield from _in_pieces(((key, *at) for key in batch.column("key").to_pylist() for at in index.blocks(key)), ["key", "shard", "block"], [pa.string(), pa.int32(), pa.int32()])


def _found(batches, shards):
    index = Index(shards)
    for batch in batches:
        asked = zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "block")), strict=True)
        yield from _in_pieces(((key, *entry) for key, n, b in asked for entry in index.entries(key, n, b)), ["key", "page", "kind", "digest", "file", "at", "size"], [pa.string()] * 5 + [pa.int64()] * 2)


def lookup(urls: DataFrame, shards: list[tuple[str, str, str]]) -> DataFrame:
    """Captures of the distinct keys of ``urls`` (url); each block is read by one task, once."""
    keys = urls.select("url").mapInArrow(_keys, "key string").distinct()
    blocks = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(partial(_blocks, shards=shards), "key string, shard int, block int")
    return blocks.repartition("shard", "block").sortWithinPartitions("shard", "block", "key").mapInArrow(partial(_found, shards=shards), _CAPTURES)


def _fetched(batches, payloads: bool):
    name, source = None, None
    for batch in batches:
        rows = []
        for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, _Ranges(file)
            row = parse(zlib.decompress(source.read(at, size), 31))
            rows.append(row if payloads else {**row, "payload": None})
        if rows:
            schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("stated_digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if source is not None:
        source.close()


def fetch(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``captures`` point at, by range reads in file order."""
    dealt = captures.select("file", "at", "size").repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(partial(_fetched, payloads=payloads), _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, index the archives, look every URL up and read the records back.

    page_id, payload_bytes, payload_digest, record_type, refers_to for each row
    of ``pages``; an empty table gives no rows.
    """
    captures = write_archives(pages)
    shards = build_index(captures)
    kind = pages.schema["page_id"].dataType
    records = fetch(lookup(pages, shards), payloads=False)
    return records.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
