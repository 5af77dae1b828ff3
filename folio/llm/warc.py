"""WARC archives: a writer of gzipped records and a splittable reader.

Every record is a gzip member of its own. The reader's tasks take byte ranges, not files: a task
scans its range for the gzip magic, tries to inflate the start of each candidate and accepts it if
a WARC header comes out, and owns the records that start in its range, reading the last one past
the range's end. So one archive of any size is read by many tasks, without an index.

A record that holds another archive as it stands could be taken for one where a range starts in it.
In archives of this writer it can't be: a payload is UTF-8, and no UTF-8 has the magic's second byte
after its first. Deflated bytes hold the magic by chance alone, and then don't inflate to a WARC header.

Files are opened through Arrow's file systems, by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bloom_of, maybe_in, row_key

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 << 20
STEP = 1 << 20
#: Bytes of a member that must inflate to a header for it to count as a record.
PROBE = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    """A header's value: one line, and no characters that end one."""
    return re.sub(r"[\x00-\x1f\x7f\x85  ]+", " ", value).strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit (whose payload is not repeated), as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    body = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(body) + out.flush()


def _write(folder: str):
    """Each task writes one archive under a name of its attempt, and hands it in as its last act."""

    def run(batches):
        system, root = _open(folder)
        context = TaskContext.get()
        path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        sink, n, size = None, 0, 0
        for batch in batches:
            if sink is None and batch.num_rows:
                sink = system.open_output_stream(path, compression=None)
            for page, url, payload, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                made = record(page, url, payload, to)
                sink.write(made)
                n, size = n + 1, size + len(made)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of ``pages`` in the scratch folder; returns (file, bytes, records), a written table.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a
    response and the others revisit it. Null html is an empty payload. A row without page_id has a
    record too, which revisits the largest page_id of its payload if there is one. A payload is held whole. Rows that repeat a
    page_id have a record each, and of equal ones none revisits the other. Of the payloads, only those
    of revisits (and a few more, by a filter of bounded size) are shuffled. The table, not the folder,
    says which files count: those of the attempts that ended well.
    """
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("row_key", row_key(F.col("page_id"), F.sha2("payload", 256)))
    known = scratch.save(rows.select("page_id", "row_key", F.sha2("payload", 256).alias("sha256"), F.length("payload").alias("size")), "digests")
    last = known.where(F.col("size") >= least).groupBy("sha256").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    last = last.where("first < refers_to or (nulls > 0 and refers_to is not null)")
    revisits = known.join(last, "sha256").where("page_id is null or page_id < refers_to").select(F.col("row_key").alias("__key"), F.col("page_id").alias("__id"), "refers_to").distinct()
    revisits = scratch.save(revisits, "revisits")
    bloom = bloom_of(revisits.select("__key"))
    same = (F.col("row_key") == F.col("__key")) & F.col("page_id").eqNullSafe(F.col("__id"))
    told = maybe_in(rows, "row_key", bloom).join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")
    rest = maybe_in(rows, "row_key", bloom, inside=False).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    folder = scratch.path("archives")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return scratch.save(told.unionAll(rest).mapInArrow(_write(folder), "file string, bytes long, records long"), "written")


# --- reading ------------------------------------------------------------------------------


def _starts(probe: bytes) -> bool:
    """Does a gzip member with a WARC header start here."""
    try:
        return zlib.decompressobj(31).decompress(probe, 64).startswith(b"WARC/")
    except zlib.error:
        return False


#: What is given to a decompressor at once: of the last piece of a member, what lies behind it is copied.
PIECE = 1 << 16


class Ahead:
    """A seekable file that is read forwards, each byte once: what was read and not yet used is kept."""

    def __init__(self, source, end: int):
        self.source, self.end, self.start, self.data = source, end, 0, b""

    def at(self, offset: int, size: int) -> bytes:
        """``size`` bytes from ``offset`` on, fewer at the end of the file."""
        inside = offset - self.start
        if not 0 <= inside <= len(self.data):
            self.data = b""
        elif inside + size <= len(self.data):
            return self.data[inside : inside + size]
        else:
            self.data = self.data[inside:]
        self.start = offset
        have = len(self.data)
        # up to the end of the range in large steps, behind it only what is asked for
        wanted = max(size - have, min(STEP, self.end - offset - have))
        self.source.seek(offset + have)
        self.data += self.source.read(wanted)
        return self.data[:size]


def records_in(source, start: int, end: int):
    """(offset, header, block) of the records that start in [start, end) of a seekable file; a record's block is held whole."""
    ahead, at = Ahead(source, end), start
    while at < end:
        limit = min(STEP, end - at)
        chunk = ahead.at(at, limit + PROBE)
        i = chunk.find(MAGIC)
        while 0 <= i < limit and not _starts(chunk[i : i + PROBE]):
            i = chunk.find(MAGIC, i + 1)
        if not 0 <= i < limit:
            at += limit
            continue
        at += i
        # from a record's start the members follow each other
        while at < end:
            inflate, out = zlib.decompressobj(31), io.BytesIO()
            size = 0
            try:
                while not inflate.eof:
                    piece = ahead.at(at + size, PIECE)
                    if not piece:
                        break
                    size += len(piece)
                    out.write(inflate.decompress(piece))
            except zlib.error:
                break
            head, _, block = out.getvalue().partition(b"\r\n\r\n")
            if not inflate.eof or not head.startswith(b"WARC/"):
                break
            fields = {}
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            yield at, fields, block[: int(fields.get("content-length", len(block)))]
            at += size - len(inflate.unused_data)
        else:
            return
        at += 1  # damaged: look for the next record
    return


READ = "file string, offset long, type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _read(folder: str, keep_payload: bool):
    def run(batches):
        system, root = _open(folder)
        for batch in batches:
            for name, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end"))):
                rows, held = [], 0
                with system.open_input_file(f"{root}/{name}") as source:
                    for offset, h, block in records_in(source, start, end):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = h.get("warc-type") == "revisit"
                        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        size = int(told[1]) if revisit and told else len(payload)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest_of(payload)
                        rows.append((name, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, payload if keep_payload and not revisit else None))
                        held += len(payload)
                        if held > 32 << 20 or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in READ.split(", ")])


def read_archives(spark: SparkSession, folder: str, files: DataFrame, range_bytes: int = RANGE_BYTES, keep_payload: bool = True) -> DataFrame:
    """Records of the archives ``files(file, bytes)`` below ``folder``, by byte ranges.

    Every record comes back once, whatever the ranges. A damaged one is passed over. Empty files and
    tables give no rows.
    """
    ranges = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("file", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    n = max(1, ranges.count())
    return ranges.repartition(min(n, 100_000), "file", "start").mapInArrow(_read(folder, keep_payload), READ)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS h, max(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS last FROM pages),
d AS (SELECT *, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(1, 6), lambda i: (strpos('0123456789abcdef', h[g * 5 + i]) - 1) * 16 ** (5 - i)))::BIGINT) AS parts FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: '{_BASE32}'[(v // 32768) + 1] || '{_BASE32}'[(v // 1024) % 32 + 1] || '{_BASE32}'[(v // 32) % 32 + 1] || '{_BASE32}'[v % 32 + 1]), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM d
"""


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    records = read_archives(spark, scratch.path("archives"), files, keep_payload=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
