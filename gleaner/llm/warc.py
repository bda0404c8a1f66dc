"""WARC archives with revisit records and a two-level capture index.

Archives: one gzip member a record (WARC/1.1). A ``response`` holds HTTP headers and the payload; of
pages with equal payloads of at least ``least`` bytes the one with the largest id is the response, and
the others are ``revisit`` records that hold the same HTTP headers without the payload and name the
response. Equal payloads are found by SHA-1; only digests that occur more than once are joined back,
from a written table whose size Spark knows, so payloads are shuffled only if that table is too large
to broadcast.

Index: captures sorted by reversed-host URL key and page id, in shards of compressed blocks of
``BLOCK`` lines (the second level), each shard with a sparse directory of its blocks' first keys (the
first level). A look-up bisects the shards' first keys, then a shard's directory, reads one block by
range, bisects its lines, and the archive is read by range at the capture's offset. Look-ups
come sorted, so a block is read once; one very frequent URL is many keys, told apart by page id.

Files are one task attempt's own and count only once Spark has committed the table that names them.

Nulls: a null html is an empty payload, a null url an empty one, a null page id sorts first and is
never referred to. Rows that repeat a page id are records each, and a look-up finds all of them. An
empty table gives no file and an empty result; extra columns are not read. One record is in memory at a time.
"""

from __future__ import annotations

import functools
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, partitions, scratch

#: Bytes of an archive file, about, and lines of an index block.
ARCHIVE, BLOCK = 512 << 20, 1024
CAPTURES = "key string, name string, offset long, length long"


def url_key(url: str | None) -> str:
    """host parts in reverse, port, path and query: ``com,example,www)/path?query``."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # not a URL: the text itself
        host, port, rest = "", "", url
    return quote(f"{host}{port}){rest}", safe="/?&=:;,@!$'()*+%#[]~")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The URL key, and the page id so that text order is number order; null first."""
    return f"{url_key(url)} {'-' * 20 if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe='/?&=:;,@!$()*+%#[]~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields; raises if a response's payload does not have the digest and length it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    urn = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"corrupt record {fields['WARC-Record-ID']}")
    return {"page_id": urn(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": urn(fields.get("WARC-Refers-To")), "payload": payload}


def write(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns the captures, written as a table."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    repeated = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "repeated")
    rows = rows.join(repeated.withColumnRenamed("digest", "__digest"), F.col("digest") == F.col("__digest"), "left")
    # A null page id is below every other.
    rows = rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        out, at, name = None, 0, None
        for batch in batches:
            found: dict[str, list] = {"key": [], "name": [], "offset": [], "length": []}
            ids, urls, digests, refers = (column(batch, c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for k, html in enumerate(column(batch, "html")):
                if out is None or at > ARCHIVE:
                    if out is not None:
                        out.close()
                    files.create_dir(base, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                data = gzip.compress(record(ids[k], urls[k], html.as_py(), digests[k], refers[k]), 6, mtime=0)
                out.write(data)
                for c, v in zip(found, (capture_key(urls[k], ids[k]), name, at, len(data))):
                    found[c].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(found)
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


INDEX = "first string, name string, n long"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Shards NAME.cdx (compressed blocks) and NAME.dir (their first keys and places), and the table of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        out, at, n, lines, directory, name = None, 0, 0, [], [], uuid.uuid4().hex

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append([lines[0].split("\t")[0], at, len(data)])
            at, lines = at + len(data), []

        for batch in batches:
            for key, file, offset, length in zip(*(column(batch, c).to_pylist() for c in ("key", "name", "offset", "length"))):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}.cdx")
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                n += 1
                if len(lines) == BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with files.open_output_stream(f"{base}/{name}.dir") as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "name": [name], "n": [n]})

    ranged = captures.repartitionByRange(partitions(captures.sparkSession), "key").sortWithinPartitions("key", "name", "offset")
    return materialize(ranged.mapInArrow(run, INDEX), "shards")


@functools.lru_cache(maxsize=4)
def directory(folder: str, name: str) -> list:
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/{name}.dir") as f:
        return json.loads(f.read())


@functools.lru_cache(maxsize=4)
def block(folder: str, name: str, offset: int, length: int) -> list[list[str]]:
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}.cdx") as f:
        return [line.split("\t") for line in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def find(folder: str, shards: list[tuple[str, str]], key: str) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of each capture of the key. ``shards``: (first key, name), sorted. A key's
    captures may go on in the next block, and in the next shard."""
    k = max(0, bisect_left(shards, (key,)) - 1)
    while k < len(shards) and shards[k][0] <= key:
        listed = directory(folder, shards[k][1])
        j = max(0, bisect_left(listed, key, key=lambda x: x[0]) - 1)
        while j < len(listed) and listed[j][0] <= key:
            lines = block(folder, shards[k][1], listed[j][1], listed[j][2])
            lo, hi = bisect_left(lines, key, key=lambda x: x[0]), bisect_right(lines, key, key=lambda x: x[0])
            for _, name, offset, length in lines[lo:hi]:
                yield name, int(offset), int(length)
            j += 1
        k += 1


def lookup(keys: DataFrame, folder: str, shards: DataFrame) -> DataFrame:
    """(name, offset, length) of the captures of ``keys`` (key). The table of shards has a row a task."""
    listed = sorted((r["first"], r["name"]) for r in shards.select("first", "name").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for key in column(batch, "key").to_pylist() for x in find(folder, listed, key)]
            yield pa.RecordBatch.from_pydict(dict(zip(("name", "offset", "length"), map(list, zip(*found)))) if found else {"name": [], "offset": [], "length": []}, schema=pa.schema([("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    ranged = keys.select("key").distinct().repartitionByRange(partitions(keys.sparkSession), "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, "name string, offset long, length long")


def read(places: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at (name, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        name, f = None, None
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payload]
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for row in batch.to_pylist():
                if row["name"] != name:
                    name, f = row["name"], files.open_input_file(f"{base}/{row['name']}")
                with gzip.GzipFile(fileobj=io.BytesIO(f.read_at(row["length"], row["offset"]))) as g:
                    got = parsed(g.read())
                for c, values in zip(columns, out):
                    values.append(got[c])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], columns)

    ordered = places.repartition(partitions(places.sparkSession), "name").sortWithinPartitions("name", "offset")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([capture_key(u, i) for u, i in zip(column(batch, "url").to_pylist(), column(batch, "page_id").to_pylist())], pa.string())})

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")).mapInArrow(run, "key string")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes archives and index, then looks every page up and reads its record."""
    folder = scratch(pages.sparkSession, "warc")
    shards = write_index(write(pages, folder, least), folder)
    return read(lookup(keys_of(pages), folder, shards), folder)
