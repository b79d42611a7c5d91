"""WARC archives: written a file a task, read back in byte ranges that need no index.

A reading task scans its range for gzip's magic bytes, takes a candidate for a member only if it decodes to a WARC
header, and owns the records that start inside its range, wherever they end.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import materialize, new_path

MAGIC = b"\x1f\x8b\x08"
SPLIT = 4 << 20
READ = 1 << 20
MOST_TASKS = 20_000
LEAST_REVISIT = 1000
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (null html: empty), digest, record_type and refers_to.

    Among payloads of `least` bytes or more with equal length and SHA-1 the largest page_id is the response, the others
    revisit it. Rows that repeat that page_id are all responses, as are groups without any page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = narrow.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "bytes", "first")
    # Short payloads have no group; a salt keeps equal ones, such as empty pages, from meeting in one task.
    salt = F.when(F.col("bytes") < least, F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)) + 1).otherwise(F.lit(0))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload")).withColumn("salt", salt)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    known = materialize(groups, "payload-groups").withColumn("salt", F.lit(0).cast("long"))
    return keyed.join(known, ["digest", "bytes", "salt"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = "none" if page_id is None else str(page_id)
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of marked() as gzip members, a file a task, into the shared folder; returns (path, size, records).

    A task writes under a name of its attempt and renames at its end, so a retried task leaves one whole file.
    """

    def run(batches):
        system, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}"
        system.create_dir(base, recursive=True)
        n, size, draft = 0, 0, f"{name}-{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    data = member(record(*row))
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if not n:
            system.delete_file(draft)
            return
        system.move(draft, f"{name}.warc.gz")
        yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.gz"], "size": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return materialize(rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "path string, size long, records long"), "manifest")


class Window:
    """Bytes of a file from an offset on, read as they are needed."""

    def __init__(self, stream, start: int):
        self.stream, self.start, self.data, self.ended = stream, start, bytearray(), False
        stream.seek(start)

    def more(self) -> bool:
        if not self.ended:
            got = self.stream.read(READ)
            self.data += got
            self.ended = not got
        return not self.ended

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.start]
        self.start = upto


def unpack(view: Window, at: int) -> tuple[bytes, int] | None:
    """The member at offset `at` and the offset behind it, or None if no WARC record starts there.

    A false magic costs what 256 bytes decompress to; each byte of a member is looked at once.
    """
    unzip, out, seen, known = zlib.decompressobj(31), [], at, False
    while not unzip.eof:
        if seen - view.start >= len(view.data) and not view.more():
            return None
        part = bytes(memoryview(view.data)[seen - view.start :][: READ if known else 256])
        try:
            out.append(unzip.decompress(part))
        except zlib.error:
            return None
        seen += len(part) - len(unzip.unused_data)
        if not known:
            head = b"".join(out)
            known = head.startswith(b"WARC/")
            if len(head) >= 5 and not known:
                return None
    return (b"".join(out), seen) if known else None


def records_of(stream, start: int, end: int):
    """Records whose member starts in [start, end)."""
    view, at = Window(stream, start), start
    while at < end:
        found = view.data.find(MAGIC, at - view.start)
        if found < 0:
            at = max(at, view.start + len(view.data) - len(MAGIC) + 1)
            view.drop(at)
            if not view.more():
                return
            continue
        at = view.start + found
        if at >= end:
            return
        got = unpack(view, at)
        if got is None:
            at += 1
            continue
        yield got[0]
        at = got[1]
        view.drop(at)


def parse(data: bytes) -> dict:
    """Fields of one record; the digest is of the payload itself where there is one."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x in (None, b"<urn:page:none>") else int(x[10:-1])
    kind = fields[b"WARC-Type"].decode()
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    whole = kind == "response"
    return {
        "page_id": number(fields[b"WARC-Record-ID"]),
        "url": fields[b"WARC-Target-URI"].decode("utf-8", "replace") if b"WARC-Target-URI" in fields else None,
        "payload_bytes": len(payload) if whole else length,
        "payload_digest": hashlib.sha1(payload).hexdigest() if whole else fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(),
        "record_type": kind,
        "refers_to": number(fields.get(b"WARC-Refers-To")),
        "payload": payload if whole else None,
    }


def read_archives(manifest: DataFrame, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of the files in (path, size): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    total = manifest.agg(F.sum("size")).head()[0] or 0
    ranges = ranges.repartition(min(MOST_TASKS, total // split + 1), "path", "start")  # a fixed number: rows are few, work is not
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(path) as stream:
                    some, held = [], 0
                    for data in records_of(stream, start, min(size, start + split)):
                        one = parse(data)
                        if not payloads:
                            one["payload"] = None
                        some.append(one)
                        held += len(one["payload"] or b"")
                        if len(some) == 2000 or held > 16_000_000:
                            yield pa.RecordBatch.from_pylist(some, schema=schema)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)

    assert names == schema.names
    return ranges.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write every page and read the archives back; one row per page.

    A null or empty page has an empty payload and is a response; a null url has no target; repeated rows stay repeated;
    a long page is one record, read whole by the task in whose range it starts; other columns are not read. An empty
    table gives an empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(marked(pages), folder), folder, payloads=payloads)
