"""WARC archives: one gzip member per record, written by tasks and read back by splittable byte ranges.

Writing. Digests are computed first, on their own narrow rows; of equal payloads of at least ``min_revisit`` bytes the
one with the largest page id stays a response and the others become revisits that refer to it. The wide rows are
shuffled once, by page id; each task writes one ``.warc.gz`` under a temporary name and renames it, so a task that
runs again replaces its file by the same bytes.

Reading. Archives are cut into byte ranges. A task looks for the gzip magic in its range, takes a candidate only if
it decodes to a WARC header (and, unless a record has just ended there, is followed by another member, by padding or by
the end of the file), and owns the records that start inside; a record may end beyond. Nothing but the range (and the
tail of its last record) is read. Where a record ends, or a file begins, and neither a record, padding nor the end
follows, a row of type ``damaged`` says where; reading goes on at the next record.

Defined results: a null html or url is empty; a null page id is a response of its own; repeated rows (equal id and
payload) are written as often as they occur, all of one kind; rows of one id with different payloads are told apart by
their digest; extra columns are never read; an empty table gives archives without records, and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

MAGIC = b"\x1f\x8b\x08"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, path string, at long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(filesystem, path) of a folder or file by its address, or by a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_bytes(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 response or revisit record; a revisit keeps the HTTP head, with the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kept_url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {kept_url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """``data`` as one gzip member, the same bytes each time."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to) of every page; one wide shuffle, by page id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    each = cut(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")))
    shared = (each.filter((F.col("size") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least"))
    revisits = (each.filter(F.col("size") >= min_revisit).join(shared, "digest").filter("page_id < refers_to")
                .select("page_id", "digest", "refers_to").distinct())
    wide = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    return wide.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``rows`` of ``with_revisits`` under ``folder``; (path, size) of each archive, one per task with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        held = f"{top}/.{task.taskAttemptId()}.tmp"
        written, out = 0, None
        for batch in batches:
            if out is None:
                out = store.open_output_stream(held, compression=None)
                info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:part:{task.partitionId()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 23\r\n\r\nsoftware: lithoscope 1\n\r\n\r\n"
                out.write(first := member(info.encode()))
                written = len(first)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, payload, digest, refers = row
                one = member(record_bytes("null" if page is None else str(page), url, payload, digest, None if refers is None else str(refers), date))
                out.write(one)
                written += len(one)
        if out is not None:
            out.close()
            store.move(held, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([written], pa.int64())], names=["path", "size"])

    ordered = rows.sortWithinPartitions("page_id", "digest", "url")
    return cut(ordered.mapInArrow(run, "path string, size long"))


class RangeReader:
    """Bytes of a file on demand: a window that grows forward in steps."""

    def __init__(self, file, size: int, start: int, step: int = 1 << 20):
        self.file, self.size, self.base, self.data, self.step = file, size, start, b"", step

    def upto(self, stop: int) -> None:
        have = self.base + len(self.data)
        if stop > have and have < self.size:
            self.file.seek(have)
            self.data += self.file.read(min(self.size, max(stop, have + self.step)) - have)

    def forget(self, before: int) -> None:
        if before - self.base > self.step:
            self.data, self.base = self.data[before - self.base:], before

    def find(self, what: bytes, at: int, stop: int) -> int:
        """First place in [at, stop) where ``what`` starts, or -1."""
        while at < stop:
            self.upto(min(stop, at + self.step) + len(what) - 1)
            end = min(stop, self.base + len(self.data))
            found = self.data.find(what, at - self.base, end - self.base + len(what) - 1)
            if found >= 0:
                return self.base + found
            if end >= min(stop, self.size):
                return -1
            at = max(at + 1, end - len(what) + 1)
            self.forget(at)
        return -1

    def padded(self, at: int) -> bool:
        """Whether nothing but zeros follows."""
        while at < self.size:
            self.upto(min(self.size, at + self.step))
            piece = self.data[at - self.base:at - self.base + self.step]
            if piece.strip(b"\0"):
                return False
            at += len(piece)
        return True

    def unpacked(self, at: int, expected: bool, first: int = 4096) -> tuple[bytes, int] | None:
        """(content, end) of the gzip member at ``at`` if it is a WARC record, else None."""
        packer, out = zlib.decompressobj(31), []
        place, size = at, 0
        try:
            while not packer.eof:
                self.upto(place + self.step)
                piece = self.data[place - self.base:place - self.base + (first if place == at else self.step)]
                if not piece:
                    return None
                place += len(piece)
                out.append(packer.decompress(piece))
                size += len(out[-1])
                if size >= 8 and not b"".join(out[:2])[:8].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        end = place - len(packer.unused_data)
        self.upto(end + 3)
        follows = self.data[end - self.base:end - self.base + 3]
        content = b"".join(out)
        return (content, end) if content.startswith(b"WARC/1.") and (expected or follows == MAGIC or self.padded(end)) else None


def parse_record(content: bytes) -> dict:
    """The fields of a record; payload and digest are of the full payload (a revisit's from its headers)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[:int(fields.get("content-length", len(rest)))]
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if kind == "revisit":
        length = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        payload = None
    else:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload}


def records_in(path: str, start: int, stop: int) -> Iterator[dict]:
    """Records of an archive that start in [start, stop)."""
    store, inner = file_system(path)
    size = store.get_file_info(inner).size
    with store.open_input_file(inner) as file:
        reader, at, expected = RangeReader(file, size, start), start, start == 0
        while 0 <= (found := reader.find(MAGIC, at, min(stop, size))):
            got = reader.unpacked(found, expected and found == at)
            if expected and (found > at or got is None) and not reader.padded(at):
                yield {"record_type": "damaged", "path": path, "at": at}
            at, expected = found + 1, False
            if got is not None:
                content, at = got
                reader.forget(found)
                expected = True
                yield parse_record(content) | {"path": path, "at": found}
        if expected and at < size and (at < stop or reader.unpacked(at, True) is None) and not reader.padded(at):
            yield {"record_type": "damaged", "path": path, "at": at}


def read_archives(archives: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """All records of ``archives`` (path, size), by ranges of ``split_bytes``; the executors make the ranges."""
    n = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    cuts = archives.filter("size > 0").select("path", starts.alias("start"), "size").select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("at", pa.int64())])
        held, size = [], 0
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in records_in(path, start, stop):
                    if not with_payload:
                        record["payload"] = None
                    held.append(record)
                    size += 200 + len(record.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return cuts.repartition(int(n)).mapInArrow(run, RECORD_SCHEMA)
