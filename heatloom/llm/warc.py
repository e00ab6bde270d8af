"""WARC archives: one gzip member per record, written by tasks and read back in byte ranges.

Equal payloads are stored once: the row with the smallest id is a response, the others
are revisits that refer to it.  Only digests are compared for that; a payload moves to
another task only if rows of equal payload are too many for a broadcast.

Archives split anywhere.  A task scans its byte range for gzip's magic bytes, takes a
candidate for a member when it inflates to a record header and decodes to its end with
the right checksum, and owns the records that start inside its range, wherever they
end.  The writer sees to it that no member holds such a candidate inside.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heatloom.llm.common import slices
from heatloom.operators.rundir import run_dir, stage

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a read, and of an archive.
SPLIT_BYTES, READ_BYTES, ARCHIVE_BYTES = 32 << 20, 1 << 20, 1 << 30
#: Rows whose payloads are Python objects at a time.
WRITE_ROWS = 64
#: Payloads below this many bytes are always responses.
LEAST_BYTES = 100
#: Groups of equal payloads that are sent to all executors, about 200 bytes each.
BROADCAST_GROUPS = 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---

def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first + "\r\n", *[f"{k}: {v}\r\n" for k, v in lines], "\r\n"]).encode()


def record_id(page_id: str | None, copy: int) -> str:
    return f"<urn:page:{'null' if page_id is None else 'id'}:{quote(page_id or '', safe='')}:{copy}>"


def page_of(rid: str | None) -> str | None:
    """The id inside a record id; None for NULL."""
    kind, page, _ = rid.strip("<>").removeprefix("urn:page:").split(":") if rid else ("null", "", "")
    return unquote(page) if kind == "id" else None


def record(page_id: str | None, copy: int, url: str | None, payload: bytes, digest: str, n_bytes: int, first: tuple[str | None] | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that refers to the response of page ``first[0]``."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(n_bytes))], "HTTP/1.1 200 OK")
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, copy)), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:  # control characters, blanks and non-ASCII are percent-encoded
        fields.insert(3, ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], 0))]
    return _head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a place inside that reads like the start of another record."""
    for level in (6, 9, 1, 5):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out = z.compress(data) + z.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and not starts_record(out[at:]):
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    # a record inside the text that every level stores as it is: fixed Huffman codes shift its bytes
    z = zlib.compressobj(6, zlib.DEFLATED, 31, 9, zlib.Z_FIXED)
    return z.compress(data) + z.flush()


def starts_record(data: bytes) -> bool:
    """Whether bytes inflate to the start of a record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


HEADER_END = re.compile(rb"\r?\n\r?\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names in lower case) and block of a decoded record; None if it is none."""
    end = HEADER_END.search(data)
    if not end or not data.startswith(b"WARC/1."):
        return None
    lines = data[: end.start()].decode("utf-8", "replace").splitlines()[1:]
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    size = fields.get("content-length", "")
    if not size.isdigit() or "warc-type" not in fields or "warc-record-id" not in fields or len(data) < end.end() + int(size):
        return None
    return fields, data[end.end() : end.end() + int(size)]


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an HTTP response."""
    end = HEADER_END.search(block)
    if not block.startswith(b"HTTP/") or not end:
        return {}, block
    pairs = (line.partition(":") for line in block[: end.start()].decode("utf-8", "replace").splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, block[end.end() :]


# --- byte ranges ---

def filesystem(path: str):
    """The store of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


class Window:
    """A moving part of a file."""

    def __init__(self, file, size: int, step: int):
        self.file, self.size, self.step, self.base, self.data = file, size, step, 0, b""

    def at(self, pos: int, least: int) -> bytes:
        """Bytes from ``pos`` on: at least ``least`` of them unless the file ends before."""
        if pos < self.base or pos > self.base + len(self.data):
            self.base, self.data = pos, b""
        have = self.base + len(self.data) - pos
        if have < least and pos + have < self.size:
            more = min(max(self.step, least - have), self.size - pos - have)
            self.file.seek(pos + have)
            self.data = self.data[pos - self.base :] + self.file.read(more)
            self.base = pos
        return self.data[pos - self.base :]


def decode(window: Window, pos: int) -> tuple[int, dict[str, str], bytes] | None:
    """(end, header fields, block) of the member at ``pos`` if it is a record, whole and with the right checksum."""
    if not starts_record(window.at(pos, 1024)[: 1 << 16]):
        return None
    z, parts, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        data = window.at(at, 1)[: window.step]
        if not data:
            return None
        try:
            parts.append(z.decompress(data))
        except zlib.error:
            return None
        at += len(data) - len(z.unused_data)
    found = parse(b"".join(parts))
    return (at, *found) if found else None


def records_in(file, size: int, start: int, stop: int, step: int = READ_BYTES) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, stop)."""
    window, pos = Window(file, size, step), start
    while pos < stop:
        data = window.at(pos, len(MAGIC))
        hit = data.find(MAGIC, 0, min(len(data), stop - pos + len(MAGIC) - 1))
        if hit < 0:
            if pos + len(data) >= min(size, stop + len(MAGIC) - 1):
                return
            pos += max(1, len(data) - len(MAGIC) + 1)
            continue
        pos += hit
        found = decode(window, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[1], found[2]
        pos = found[0]


# --- tables ---

def write_warc(
    pages: DataFrame, folder: str, date: str = DATE, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Writes a record for every row of (page_id, url, html) and returns the archives: path, size, records.

    The payload is the html in UTF-8, NULL as empty.  Of rows with equal payloads of at
    least ``least`` bytes, the one with the smallest page_id (NULL last; then the
    smallest url) is a response, the others are revisits; shorter ones are all
    responses.  Repeated rows have a record each.  page_id may have any type that casts
    to a string and back.  Other columns are not read; no row gives no archive.  The
    table names the archives of finished tasks alone; what a lost task has left in the
    folder is in no row.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rank = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    groups = (
        keyed.where(F.col("n_bytes") >= least).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("twins"))
        .groupBy("digest").agg(F.min(F.struct(rank.alias("rank"), "twins")).alias("first"), F.sum("twins").alias("n")).where("n > 1")
        .select(F.col("digest").alias("_digest"), F.col("first.rank.id").alias("_id"), F.col("first.rank.url").alias("_url"), F.col("first.twins").alias("_twins"))
    )
    groups = stage(groups, "warc-groups")
    n, twins = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("_twins"), F.lit(0))).first()
    joined = keyed.join(F.broadcast(groups) if n <= broadcast_groups else groups, F.col("digest") == F.col("_digest"), "left")
    leads = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    later = F.col("_digest").isNotNull() & ~leads
    text = lambda c: F.col(c).cast("string").alias(c)

    def rows(df: DataFrame, copy: Column, revisit: Column) -> DataFrame:
        return df.select(text("page_id"), copy.cast("long").alias("copy"), "url", F.when(~revisit, F.col("payload")).alias("payload"),
                         "digest", "n_bytes", revisit.alias("revisit"), F.when(revisit, F.col("_id").cast("string")).alias("first"))

    single = joined.where(later | F.col("_digest").isNull() | (F.col("_twins") == 1)) if twins > 1 else joined
    # records of equal ids differ in a number; 0 is the response that others refer to
    out = rows(single, F.when(later | F.col("_digest").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)), later)
    if twins > 1:  # rows equal in every column: one response, the others by their number
        equal = joined.where(~later & (F.col("_twins") > 1)).groupBy("digest", "page_id", "url", "n_bytes", "_id").agg(
            F.first("payload").alias("payload"), F.count(F.lit(1)).alias("_twins"))
        first = rows(equal, F.lit(0), F.lit(False))
        rest = equal.drop("payload").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_twins") - 1)))
        out = out.unionAll(first).unionAll(rows(rest.withColumn("payload", F.lit(None).cast("binary")), -F.col("_copy"), F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        done, stream, name, size, count = [], None, "", 0, 0
        for b in slices(batches, WRITE_ROWS):
            for r in b.to_pylist():
                if stream is None:
                    if not done:
                        store.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream = store.open_output_stream(f"{base}/{name}", compression=None)
                    stream.write(start := member(info_record(date)))
                    size, count = len(start), 1
                data = member(record(r["page_id"], r["copy"], r["url"], r["payload"] or b"", r["digest"], r["n_bytes"],
                                     (r["first"],) if r["revisit"] else None, date))
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    stream.close()
                    done.append((f"{folder}/{name}", size, count))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", size, count))
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("path", "size", "records"))},
                                         schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return stage(out.mapInArrow(run, "path string, size long, records long"), "warc-archives")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the archives in a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


READ_SCHEMA = ("path string, offset long, record_type string, record_id string, target_uri string, date string, "
               "refers_to string, payload_digest string, payload_bytes long, payload binary")


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, tasks: int | None = None) -> DataFrame:
    """All records of archives (path, size), read in ranges of ``split_bytes``: one row per record.

    path, offset (of the member), record_type, record_id, target_uri, date, refers_to
    (record id, of revisits), payload_digest (bare SHA-256 in hex), payload_bytes,
    payload (of responses; NULL for others).  Digest and length of a response are taken
    from its payload, those of a revisit from its header fields.  Bytes that belong to no
    whole record with the right checksum are passed over; an archive without records, or
    none at all, gives no row.  A record may be longer than a range and begin anywhere in
    it; one record must fit into memory.
    """
    ranges = archives.select("path", "size").where("size > 0").withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))))
    n = tasks or max(archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.repartition(n, "path", "start").select("path", "size", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def full(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                store, path = filesystem(r["path"])
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, fields, block in records_in(f, r["size"], r["start"], min(r["size"], r["start"] + split_bytes)):
                        rows.append(row := (r["path"], offset, *_row(fields, block)))
                        held += len(row[-1] or b"")
                        if held >= READ_BYTES * 4 or len(rows) >= 2000:
                            yield full(rows)
                            rows, held = [], 0
                if rows:
                    yield full(rows)

    return ranges.mapInArrow(run, READ_SCHEMA)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"].lower()
    http, payload = http_parts(block) if fields.get("content-type", "").startswith("application/http") else ({}, block)
    if kind == "revisit":
        digest, size, payload = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, http.get("content-length", ""), None
        size = int(size) if size.isdigit() else None
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return (kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), digest, size, payload)


def page_id_of(col: str, kind: str) -> Column:
    """The page id inside a record id, as ``write_warc`` names records."""
    parts = F.split(F.regexp_extract(F.col(col), "^<urn:page:(.*)>$", 1), ":")
    page = F.when(F.get(parts, F.lit(0)) == "id", F.url_decode(F.get(parts, F.lit(1))))
    return page.cast(kind)


def archived_pages(pages: DataFrame, split_bytes: int = SPLIT_BYTES, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload, one row per page.

    refers_to is the page_id of the response that a revisit refers to, else NULL.  See
    ``write_warc`` for NULLs, ties and repeated rows.
    """
    spark = pages.sparkSession
    archives = write_warc(pages, folder or run_dir(spark, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()
    read = read_warc(archives, split_bytes).where(F.col("record_type").isin("response", "revisit"))
    return read.select(page_id_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page_id_of("refers_to", kind).alias("refers_to"), "payload")
