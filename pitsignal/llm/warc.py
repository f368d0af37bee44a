"""WARC archives of page captures: writing with revisits, reading, transaction assembly.

A page becomes one transaction of three records: a request, a response (or a revisit when
another page with the same payload has a larger page_id), and a metadata record.  Request
and metadata name the response record in WARC-Concurrent-To.  Reading parses the archives record by
record and ``assemble`` joins the three kinds through their concurrent-to identifiers, in
whichever direction a link is written, into one nested row per capture.

Records are gzip members of their own.  Ids are name-based UUIDs of (page_id, payload digest,
url, occurrence), so a repeated task writes the same file.  A null html is an empty payload; a
null page_id orders before every other; of fully repeated rows the first occurrence is the
response and the others revisit it.  Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import among, join_on, new_folder, stage
from pitsignal.shipping import ship_by_value

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str, url: str, occurrence: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}|{page_id}|{digest}|{url}|{occurrence}')}>"


def one_line(text: str | None) -> str:
    """A header value: line ends and leading blanks would end or fold the header."""
    return " ".join((text or "").split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def transaction(page: dict, date: str) -> Iterator[bytes]:
    """The three records of one page; ``page`` has page_id, url, html, occurrence, kept_id, kept_url."""
    html = (page["html"] or "").encode()
    digest, url, n = base32_sha1(html), page["url"] or "", page["occurrence"]
    target = one_line(url)
    main = record_id("response", page["page_id"], digest, url, n)
    common = lambda kind, rid: [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target)]
    linked = ("WARC-Concurrent-To", main)
    path = target.split("/", 3)[3] if target.count("/") >= 3 else ""
    yield record([*common("request", record_id("request", page["page_id"], digest, url, n)), linked,
                  ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\n\r\n".encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page["revisit"]:
        first = record_id("response", page["kept_id"], digest, page["kept_url"] or "", 0)
        yield record([*common("revisit", main), *http, ("WARC-Profile", PROFILE), ("WARC-Refers-To", first),
                      ("WARC-Refers-To-Target-URI", one_line(page["kept_url"]))], head)
    else:
        yield record([*common("response", main), *http], head + html)
    fields = [("page-id", page["page_id"]), ("payload-length", len(html))]
    yield record([*common("metadata", record_id("metadata", page["page_id"], digest, url, n)), linked,
                  ("Content-Type", "application/warc-fields")],
                 "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode())


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, occurrence, revisit, kept_id, kept_url.

    Roles come from digests alone.  Pages whose digest a bit set over the repeated digests
    rules out are responses where they stand; only the others' html is shuffled, by
    (digest, page_id), so a payload that many pages share is spread.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(html.cast("binary"))).alias("digest"),
                        F.octet_length(html).alias("bytes"))
    shared = stage(rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", F.col("url").isNotNull().alias("named"), "url")).alias("kept")
    ).where("n > 1").select("digest", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url")), "shared")
    repeated = among(F.xxhash64("digest"), shared.select(F.xxhash64("digest"))) & (F.col("bytes") >= min_bytes)
    alone = rows.where(~repeated).select(
        "page_id", "url", "html", F.lit(0).alias("occurrence"), F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("kept_id"),
        F.lit(None).cast("string").alias("kept_url"))
    some = rows.where(repeated)
    roles = some.select("digest", "page_id").distinct().join(shared.withColumn("shared", F.lit(True)), "digest", "left").withColumn(
        "shared", F.coalesce("shared", F.lit(False)))
    placed = join_on(some, roles, ["digest", "page_id"])
    in_page = Window.partitionBy("digest", "page_id", "url").orderBy("bytes")
    numbered = placed.withColumn("occurrence", F.row_number().over(in_page) - 1)
    first = (F.col("occurrence") == 0) & F.col("page_id").eqNullSafe(F.col("kept_id")) & F.col("url").eqNullSafe(F.col("kept_url"))
    return alone.unionByName(numbered.select(
        "page_id", "url", "html", "occurrence", (F.col("shared") & ~first).alias("revisit"), "kept_id", "kept_url"))


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as WARC files under ``folder``; returns one manifest row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, sink, count = TaskContext.get(), None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                if sink is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"pages-{task.partitionId():06d}.warc.gz"
                    part = f"{root}/.{name}-{task.taskAttemptId()}"
                    sink = store.open_output_stream(part, compression=None)
                    info = b"software: pitsignal\r\nformat: WARC File Format 1.1\r\n"
                    sink.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", task.partitionId(), "", name, 0)),
                                              ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)))
                page = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                for data in transaction(page, date):
                    sink.write(member(data))
                count += 1
        if sink is not None:
            size = sink.tell()
            sink.close()
            store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_pages": [count], "n_bytes": [size]},
                                             schema=pa.schema([("file", pa.string()), ("n_pages", pa.int64()), ("n_bytes", pa.int64())]))

    return stage(_roles(pages, min_bytes).mapInArrow(write, "file string, n_pages long, n_bytes long"), "archives")


def members(source) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    unpack, parts, pending = zlib.decompressobj(31), [], source.read(_CHUNK)
    while pending:
        parts.append(unpack.decompress(pending))
        if unpack.eof:
            yield b"".join(parts)
            pending, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            pending = pending or source.read(_CHUNK)
        else:
            pending = source.read(_CHUNK)
    if parts:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, list[str]], bytes]:
    """Headers (lower-case names, repeated ones listed) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, list[str]] = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    return headers, rest[:int(headers["content-length"][0])]


RECORD = ("kind string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary, fields map<string,string>")


def read_records(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """One row per request, response, revisit and metadata record of the files.

    A response's payload is held against its digest; ``with_payload`` also returns it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())),
                         ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                         ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as source:
                    for data in members(source):
                        headers, block = parse(data)
                        get = lambda name: headers.get(name, [None])[0]
                        kind, digest, payload, fields = get("warc-type"), get("warc-payload-digest"), None, None
                        if kind == "warcinfo":
                            continue
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest and base32_sha1(payload) != digest.removeprefix("sha1:"):
                                raise ValueError(f"{get('warc-record-id')}: the payload does not match its digest")
                        if kind == "metadata":
                            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
                            fields = [(a.strip(), b.strip()) for a, _, b in pairs]
                        rows.append({
                            "kind": kind, "record_id": get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to", []),
                            "target_uri": get("warc-target-uri"), "date": get("warc-date"), "refers_to": get("warc-refers-to"),
                            "payload_digest": digest and digest.removeprefix("sha1:"),
                            "payload_bytes": None if payload is None else len(payload),
                            "payload": payload if with_payload else None, "fields": fields})
                        held += len(data) if with_payload else 0
                        if len(rows) >= 5_000 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    files = max(1, manifest.count())
    return manifest.select("file").repartitionByRange(files, "file").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: ``main`` and its ``request`` and ``metadata`` records, nested.

    A link counts in either direction and once; captures without request or metadata keep
    nulls there, and of several the one with the smallest record id is taken.
    """
    main = records.where(F.col("kind").isin("response", "revisit"))
    other = records.where(F.col("kind").isin("request", "metadata"))
    whole: Column = F.struct(*(c for c in records.columns if c not in ("payload", "concurrent_to")))
    named = other.select(F.explode("concurrent_to").alias("main_id"), "kind", whole.alias("record"))
    backward = main.select(F.col("record_id").alias("main_id"), F.explode("concurrent_to").alias("other_id"))
    links = named.unionByName(
        backward.join(other.select(F.col("record_id").alias("other_id"), "kind", whole.alias("record")), "other_id").drop("other_id"))
    least = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("record")), F.when(F.col("kind") == kind, F.col("record.record_id")))
    parts = links.groupBy("main_id").agg(least("request").alias("request"), least("metadata").alias("metadata"))
    mains = main.select(F.col("record_id").alias("main_id"), F.struct(*records.columns).alias("main"))
    return mains.join(parts, "main_id", "left")


def captures(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back and describe each capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response).
    """
    spark: SparkSession = pages.sparkSession
    records = read_records(write_archives(pages, new_folder(spark, "warc"), min_bytes=min_bytes))
    nested = assemble(records.select("kind", "record_id", "concurrent_to", "refers_to", "payload_digest", "fields"))
    flat = nested.select(
        "main_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("metadata.fields")["payload-length"].cast("long").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"), F.col("main.kind").alias("record_type"),
        F.col("main.refers_to").alias("first_id"))
    flat = stage(flat, "captures")
    firsts = flat.where("record_type = 'response'").select(F.col("main_id").alias("first_id"), F.col("page_id").alias("refers_to"))
    return flat.join(firsts, "first_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ship_by_value(__name__)
