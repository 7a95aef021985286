"""WARC archives: a deduplicating writer and a reader that salvages what follows damage."""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, salted_lookup, shared_dir, table

#: Compressed bytes after which the writer opens the next archive.
ARCHIVE_BYTES = 16 << 20
#: Smaller payloads are never stored as revisits.
LEAST_REVISIT = 100
#: Duplicated payloads that are known everywhere without a shuffle; about 100 bytes each.
BROADCAST_ROWS = 100_000
WINDOW, HEAD = 1 << 20, 1 << 12

_MANIFEST = "path string, records long, bytes long"
_RECORD = "path string, start long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_end long, reason string"


def roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload digest and first: the smallest page_id with the same payload.

    first is null for payloads under LEAST_REVISIT bytes and for those that occur once.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    seen = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(seen.filter("n > 1").drop("n"))
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(again), "digest", "left")
    return salted_lookup(rows, again, "digest", "page_id")


def open_file(path: str, mode: str):
    """A file in the shared store, by plain path, file: URI or any store that Arrow knows."""
    if re.match(r"file:|/", path):
        local = re.sub(r"^file:/*", "/", path)
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; a revisit of another page's payload carries no payload of its own."""
    revisit = first is not None and page_id != first
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record a row of pages into gzipped archives and returns the manifest (path, records, bytes).

    A task names its archives after its attempt, and only an attempt that succeeds enters the manifest, so lost
    executors leave no half-written archive in it. A null html is an empty payload, a null url is left out, a
    null page_id has the id none. Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id holds
    the payload (all rows of that page_id, if it repeats) and the others refer to it. Columns besides page_id,
    url and html are left out; an empty table writes nothing.
    """

    def task(batches):
        at = TaskContext.get()
        stem, k, out, path, n, size, made = f"{folder}/{at.partitionId():06d}-{at.taskAttemptId()}", 0, None, "", 0, 0, []
        for batch in batches:
            for page, url, html, digest, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")]):
                if out is None:
                    path, n, size, k = f"{stem}-{k}.warc.gz", 0, 0, k + 1
                    out = open_file(path, "wb")
                data = member(record(page, url, html.encode(), digest, first))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["path", "records", "bytes"])

    return materialize(roles(pages).select("page_id", "url", "html", "digest", "first").mapInArrow(task, _MANIFEST))


# --- reading ----------------------------------------------------------------------------------------


def inflate(f, start: int) -> tuple[bytes, int | None]:
    """What can be read of the member at start, and where it ends: None if it is damaged or cut off."""
    f.seek(start)
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        chunk = f.read(WINDOW)
        if not chunk:
            return b"".join(parts), None
        for k in range(0, len(chunk), 1024):  # in small steps, so that little is lost before the damage
            try:
                parts.append(z.decompress(chunk[k : k + 1024]))
            except zlib.error:
                return b"".join(parts), None
            if z.eof:
                return b"".join(parts), f.tell() - len(chunk) + min(k + 1024, len(chunk)) - len(z.unused_data)
    return b"".join(parts), f.tell()


def search(f, start: int, mark: bytes, good) -> int:
    """The first place from start on that holds mark and is good; the file's end if there is none."""
    at, held = start, b""
    f.seek(start)
    while True:
        chunk = f.read(WINDOW)
        held += chunk
        i = held.find(mark)
        while i >= 0:
            if good(at + i):
                return at + i
            i = held.find(mark, i + 1)
        if not chunk:
            return at + len(held)
        keep = len(mark) - 1
        at, held = at + len(held) - keep, held[len(held) - keep :]
        f.seek(at + len(held))


def begins_record(f, at: int) -> bool:
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def begins_line(f, at: int) -> bool:
    if at == 0:
        return True
    f.seek(at - 1)
    return f.read(1) == b"\n"


def parse(data: bytes) -> tuple[dict, bytes, int]:
    """Headers and block of the record at the start of data, and its length; ValueError if a check fails."""
    head, mark, _ = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("no version line")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = len(head) + 4
    end = begin + int(fields["content-length"])
    block = data[begin:end]
    if len(block) != end - begin or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where it should")
    kind, _, want = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != want:
        raise ValueError("wrong block digest")
    return fields, block, end + 4


def page_of(urn: str) -> int | None:
    m = re.search(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def understood(fields: dict, block: bytes) -> dict:
    """What a record says; ValueError if its payload fails the digest it names."""
    payload, want = block, fields.get("warc-payload-digest", "").partition(":")[2]
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get("warc-type", "")
    out = {"page_id": page_of(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to", ""))}
    if kind == "revisit":
        return out | {"payload_bytes": None, "payload_digest": want or None, "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if want and fields["warc-payload-digest"].startswith("sha256:") and digest != want:
        raise ValueError("wrong payload digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def records_of(data: bytes, at: int):
    """Records and gaps of an inflated member that starts at byte at: after a failed check the next version line is searched for."""
    i = 0
    while i < len(data):
        try:
            fields, block, n = parse(data[i:] if i else data)
            yield {"start": at, **understood(fields, block)}
            i += n
        except ValueError as why:
            following = data.find(b"\nWARC/1.", i + 1)
            yield {"start": at, "gap_end": None, "reason": f"{why}, inflated bytes {i} to {following + 1 or len(data)}"}
            i = following + 1 or len(data)


def salvage(f, gzipped: bool):
    """Records and gaps of an archive in order: dicts with start and either a record's fields or gap_end, reason.

    At a failed check the reader looks for the next member that opens with a version line (or the next version
    line of a plain archive), logs the bytes in between as a gap and goes on there. Records of a member before and
    behind a bad one are kept, as are those before the place where a member is damaged.
    """
    at, end = 0, f.seek(0, io.SEEK_END)
    while at < end:
        try:
            if gzipped:
                data, after = inflate(f, at)
                found = list(records_of(data, at))
                # of a member that breaks off, the gap below tells of what it lost
                yield from (x | {"gap_end": after} if x.get("reason") else x for x in found if after is not None or not x.get("reason"))
                if after is None:
                    raise ValueError("damaged member")
            else:
                f.seek(at)
                data = f.read(HEAD)
                while b"\r\n\r\n" not in data and len(data) < WINDOW and (more := f.read(HEAD)):
                    data += more
                m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data)
                head = data.find(b"\r\n\r\n")
                if m and m.start() < head and head + 8 + int(m[1]) > len(data):
                    data += f.read(head + 8 + int(m[1]) - len(data))
                fields, block, n = parse(data)
                yield {"start": at, **understood(fields, block)}
                after = at + n
        except ValueError as why:
            mark, good = (b"\x1f\x8b\x08", begins_record) if gzipped else (b"WARC/1.", begins_line)
            after = search(f, at + 1, mark, lambda i: good(f, i))
            yield {"start": at, "gap_end": after, "reason": str(why)}
        at = after


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives named in manifest.path, each archive read by one task in windows.

    A gap has a reason and the byte range start to gap_end and no record fields. Missing header fields are null.
    """
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    spark = manifest.sparkSession
    out_schema = spark.createDataFrame([], _RECORD).schema
    types = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in out_schema])

    def task(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path, "rb") as f:
                    for x in salvage(f, path.endswith(".gz")):
                        if not payload:
                            x["payload"] = None
                        rows.append({n: x.get(n) for n in names} | {"path": path})
                        size += 200 + len(x.get("payload") or b"")
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(min(files, 10_000)).mapInArrow(task, out_schema)


def pages_of(records: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row a record that could be read: revisits take their length from the response of the id and digest they refer to.

    With the manifest of archives that must be whole, RuntimeError if there are gaps or records are missing.
    """
    rows = materialize(records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "reason"))
    if manifest is not None:
        wrote = manifest.agg(F.sum("records")).first()[0] or 0
        got = rows.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("read"), F.count("reason").alias("gaps")).first()
        if got["gaps"] or got["read"] != wrote:
            raise RuntimeError(f"{wrote} records were written and {got['read']} read, with {got['gaps']} gaps")
    rows = rows.filter("reason is null").drop("reason")
    # an id may have several responses, so the one that a revisit means is named by its digest too
    means = rows.filter("record_type = 'revisit'").drop("payload_bytes").withColumn("_of", F.concat_ws(":", "refers_to", "payload_digest"))
    held = rows.filter("record_type = 'response'").withColumn("_of", F.concat_ws(":", "page_id", "payload_digest"))
    held = held.join(means.select("_of").distinct(), "_of", "left_semi").groupBy("_of").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = salted_lookup(means, held, "_of", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.filter("record_type = 'response'").select(*revisits.columns).unionByName(revisits)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write(table(spark, sf_dir, "pages"), folder)
    return pages_of(read(archives, payload=False), archives)
