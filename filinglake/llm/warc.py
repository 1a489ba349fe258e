"""WARC archives: captures written as request, response or revisit, and metadata records, and put together again.

Every page is a capture of three records tied by WARC-Concurrent-To. A payload
of at least ``least`` bytes that several pages share is stored once, with the
page of least id (then least URL); the others are revisits, whose block is the
HTTP head alone, as the revisit profile has it. Each record is a gzip member
of its own, so (file, offset) finds any of them; a task starts a new file once
one has ``file_bytes``.

Reading scans the files record by record, checks every payload against its
digest, and meets requests, responses and metadata in joins on record ids,
whichever record of a capture names which, and wherever they are stored. Payloads do not move: a
capture holds the place of its response, and ``payloads`` fetches by place.

A null html is the empty payload; a null url leaves out the target; control
characters and blanks in urls are percent-escaped. Null ids are revisits of any page with an id; rows
alike in id, url and payload are one page, which may have several responses.
Very long payloads are written and checked in pieces. Other columns
are ignored. An empty table makes no file.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglake.llm._shared import fresh_path, spread_left, staged

DATE = "2020-01-01T00:00:00Z"  # pages carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1d8a5e-3c5b-4d0e-9a53-0f3c2b7d1e42")
PIECE = 1 << 20
READ = 1 << 16  # members are small, and each leaves a copy of what was read behind it
MANIFEST = "path string, file string, n_records long, n_bytes long"
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, fields map<string,string>, file string, offset long, length long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(kind: str, page_id, url, digest: str) -> str:
    """The same page has the same ids wherever it is written."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, repr((kind, page_id, url, digest)))}>"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


class ArchiveWriter:
    """Appends records, each a gzip member, to one file."""

    def __init__(self, sink):
        self.sink, self.n_records, self.n_bytes = sink, 0, 0

    def add(self, kind: str, rid: str, headers: list[tuple[str, str | None]], block: list) -> None:
        head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Length", str(sum(map(len, block))))]
        text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (text.encode(), *block, b"\r\n\r\n"):
            for at in range(0, len(part), PIECE):
                self._put(z.compress(part[at : at + PIECE]))
        self._put(z.flush())
        self.n_records += 1

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.n_bytes += len(raw)


def write(pages: DataFrame, path: str | None = None, least: int = 0, file_bytes: int = 1 << 30) -> DataFrame:
    """Write the captures of ``pages`` (page_id, url, html) under ``path`` and return the manifest, a row a file.

    Shared payloads are found by SHA-1 in a narrow pass, and only those
    are joined back: very frequent ones by broadcast, the others by shuffle. Each task writes to names of its own; only files in the
    written manifest count.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    ordered = F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.coalesce("url", F.lit("")).alias("name"), F.col("url").isNull().alias("bare"))
    shared = rows.filter(F.col("size") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(ordered).alias("origin")).filter("n > 1")
    shared = staged(shared, "warc-shared")
    met = spread_left(rows, shared, "sha", F.col("n"), pages.count())
    ready = met.select("page_id", "url", "payload", "sha", F.when(~F.col("origin.late"), F.col("origin.page_id")).alias("origin"), F.when(~F.col("origin.bare"), F.col("origin.name")).alias("origin_url"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        sink = out = name = None
        done: list[tuple] = []

        def close() -> None:
            sink.close()
            done.append((path, name, out.n_records, out.n_bytes))

        for batch in batches:
            for page_id, url, payload, sha, origin, origin_url in zip(*(batch.column(k) for k in range(6))):
                page_id, url, sha, origin, origin_url = page_id.as_py(), url.as_py(), sha.as_py(), origin.as_py(), origin_url.as_py()
                if out is not None and out.n_bytes >= file_bytes:
                    close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    out = ArchiveWriter(sink)
                _capture(out, page_id, url, payload.as_buffer(), sha, origin, origin_url)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "file", "n_records", "n_bytes"), map(list, zip(*done)))))

    return staged(ready.mapInArrow(put, MANIFEST), "warc-manifest")


def _capture(out: ArchiveWriter, page_id, url, payload, sha: str, origin, origin_url) -> None:
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    rid = record_id("response", page_id, url, digest)
    target = None if url is None else _target(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if origin is None or (origin, origin_url) == (page_id, url):
        out.add("response", rid, common, [http, memoryview(payload)])
    else:
        first = record_id("response", origin, origin_url, digest)
        out.add("revisit", rid, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", first), ("WARC-Refers-To-Target-URI", None if origin_url is None else _target(origin_url)), ("WARC-Refers-To-Date", DATE)], [http])
    host = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", target or "")
    asked = f"GET {host and host[2] or '/'} HTTP/1.1\r\nHost: {host[1] if host else ''}\r\n\r\n".encode()
    out.add("request", record_id("request", page_id, url, digest), [("WARC-Target-URI", target), ("WARC-Concurrent-To", rid), ("Content-Type", "application/http; msgtype=request")], [asked])
    known = b"" if page_id is None else f"page_id: {page_id}\r\n".encode()
    out.add("metadata", record_id("metadata", page_id, url, digest), [("WARC-Target-URI", target), ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields")], [known])


class _Members:
    """The bytes of one gzip member after another, in pieces, and where each begins."""

    def __init__(self, source):
        self.source, self.rest, self.taken = source, b"", 0

    def _more(self) -> bytes:
        raw = self.rest or self.source.read(READ)
        if not self.rest:
            self.taken += len(raw)
        self.rest = b""
        return raw

    def at(self) -> int | None:
        """Where the next member begins; none at the end."""
        self.rest = self._more()
        return self.taken - len(self.rest) if self.rest else None

    def member(self) -> Iterator[bytes]:
        z, raw = zlib.decompressobj(31), b""
        while not z.eof:
            raw = raw or self._more()
            got = z.decompress(raw, PIECE)
            if not raw and not got:
                raise ValueError("the archive ends inside a record")
            raw = z.unconsumed_tail
            if got:
                yield got
        self.rest = z.unused_data


def _fields(raw: bytes) -> list[tuple[str, str]]:
    pairs = (s.split(":", 1) for s in raw.decode("utf-8", "replace").split("\r\n") if ":" in s)
    return [(k.strip().lower(), v.strip()) for k, v in pairs]


def _head(pieces: Iterator[bytes], end: bytes = b"\r\n\r\n") -> tuple[bytes, bytes]:
    """Up to the first blank line, and what was read behind it."""
    held = b""
    for piece in pieces:
        held += piece
        if end in held:
            break
    head, _, rest = held.partition(end)
    return head, rest


def records(source, name: str) -> Iterator[tuple]:
    """Rows of ``RECORD`` of one archive, in its order; a response whose payload does not have its digest is an error."""
    members = _Members(source)
    while (offset := members.at()) is not None:
        pieces = members.member()
        head, rest = _head(pieces)
        pairs = _fields(head)
        held = dict(pairs)
        kind, left = held.get("warc-type"), int(held["content-length"])

        def block(rest=rest, left=left, pieces=pieces) -> Iterator[bytes]:
            while left > 0:
                rest = rest or next(pieces)
                yield rest[:left]
                left -= min(left, len(rest))
                rest = b""

        body = block()
        size = digest = fields = None
        if kind in ("response", "revisit"):
            http, start = _head(body)
            said = dict(_fields(http)).get("content-length")
            marked = held.get("warc-payload-digest", "").partition(":")[2]
            sha, n = hashlib.sha1(start), len(start)
            for piece in body:
                sha.update(piece)
                n += len(piece)
            if kind == "response":
                size, digest = n, base64.b32encode(sha.digest()).decode()
                if marked and marked != digest:
                    raise ValueError(f"payload of {held['warc-record-id']} does not match its digest")
            else:
                size, digest = int(said) if said is not None else None, marked or None
        else:
            raw = b"".join(body) if held.get("content-type") == "application/warc-fields" or kind == "request" else None
            if raw is not None:
                fields = _fields(raw)
        for _ in body:
            pass
        for _ in pieces:
            pass
        yield (
            held.get("warc-record-id"), kind, [v for k, v in pairs if k == "warc-concurrent-to"], held.get("warc-refers-to"), held.get("warc-target-uri"), held.get("warc-date"), size, digest, fields, name, offset, members.taken - len(members.rest) - offset
        )


_RECORD_ARROW = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("fields", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def scan(manifest: DataFrame) -> DataFrame:
    """Every record of the archives of a manifest (path, file), a task a file, in pieces."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = _fs(row["path"])
                uri = f"{row['path'].rstrip('/')}/{row['file']}"
                out: list[tuple] = []
                with fs.open_input_stream(posixpath.join(root, row["file"]), compression=None) as source:
                    for r in records(source, uri):
                        out.append((*r[:8], None if r[8] is None else list(dict(r[8]).items()), *r[9:]))
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_ARROW.types)], schema=_RECORD_ARROW)

    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return manifest.select("path", "file").repartition(width).mapInArrow(read, RECORD)


def captures(manifest: DataFrame) -> DataFrame:
    """One nested row a response or revisit: request, response, metadata, and the response that a revisit refers to.

    A request or metadata record belongs to the response that it names or that names it; metadata may also name the request.
    Of several requests or metadata records of one response that of least id is taken. A response without them has nulls there.
    """
    every = staged(scan(manifest), "warc-records")
    main = every.filter(F.col("type").isin("response", "revisit"))
    naming = main.select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("rid"))

    def of(kind: str) -> DataFrame:
        """(to, rid, one): records of a kind with the record that each names or is named by."""
        own = every.filter(F.col("type") == kind).select(F.col("record_id").alias("rid"), F.struct("record_id", "target_uri", "date", "fields", "file", "offset", "length").alias("one"), "concurrent_to")
        return own.select(F.explode("concurrent_to").alias("to"), "rid", "one").union(own.join(naming, "rid").select("to", "rid", "one"))

    asked, told = of("request"), of("metadata")
    far = told.withColumnRenamed("to", "request_id").join(asked.select(F.col("rid").alias("request_id"), "to"), "request_id").select("to", "rid", "one")
    requests = asked.groupBy("to").agg(F.min_by("one", "rid").alias("request"))
    metadata = told.union(far).groupBy("to").agg(F.min_by("one", "rid").alias("metadata"))
    response = F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "file", "offset", "length").alias("response")
    rows = main.select(F.col("record_id").alias("to"), response).join(requests, "to", "left").join(metadata, "to", "left")
    return rows.select("request", "response", "metadata")


def page_rows(caught: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page ids) of captures; revisits of one page meet it in many tasks."""
    rows = staged(caught.select(F.col("metadata.fields")["page_id"].try_cast("long").alias("page_id"), "response.record_id", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest"), "warc-captures")
    asked = rows.filter("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    pages = rows.filter("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("page"))
    table = staged(asked.join(pages, "refers_to"), "warc-origins")
    met = spread_left(rows, table, "refers_to", F.col("n"), rows.count())
    return met.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("page").alias("refers_to"))


def payloads(places: DataFrame) -> DataFrame:
    """(record_id, payload) of records by their place: record_id, file, offset, length."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _fs(row["file"])
                with fs.open_input_file(path) as source:
                    source.seek(row["offset"])
                    raw = zlib.decompress(source.read(row["length"]), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                block = rest[: int(dict(_fields(head))["content-length"])]
                yield pa.RecordBatch.from_pydict({"record_id": [row["record_id"]], "payload": [block.partition(b"\r\n\r\n")[2]]})

    return places.select("record_id", "file", "offset", "length").mapInArrow(fetch, "record_id string, payload binary")
