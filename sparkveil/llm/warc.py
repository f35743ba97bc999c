"""WARC archives: writing pages with identical-payload revisits, and a reader that salvages.

The writer puts every record in a gzip member of its own, in archives of bounded size. The reader
streams an archive; when a check fails (gzip checksum, record header, length, digest), it searches for the
next valid member or version line, goes on from there, and reports the bytes it passed over as a gap.
Records and members may be of any length: blocks run through the digest piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, written

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSION_MARK = b"WARC/1."
MEMBER_MARK = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, content_offset long, kind string, record_id string, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary, gap_bytes long, reason string"
)


@dataclass(frozen=True)
class Params:
    """archive_bytes: size at which the writer starts another archive; read_bytes: of one read; held_bytes:
    content of a member that is kept while its checksum is verified (a longer one is inflated twice); line_bytes: of the
    longest header line, such as a url; level: of the compression."""

    archive_bytes: int = 256 << 20
    read_bytes: int = 1 << 20
    held_bytes: int = 4 << 20
    line_bytes: int = 16 << 20
    level: int = 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record, not compressed. A revisit's block is the HTTP header alone, whose Content-Length
    still tells the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join(uri.split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, p: Params = Params(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row of `pages` into archives in `folder` (a uri that pyarrow opens) and
    return the manifest: path, records, bytes.

    Of the rows with equal payloads (UTF-8; null: empty) those with the largest key are responses and
    the others revisits of it; a null key is smaller than any other. Payloads are compared by SHA-1 and
    length. Only (digest, key) is grouped; the bodies are never shuffled by content but for one join,
    whose hot digests can be split. A repeated or failed task leaves archives that no manifest names.
    Repeated rows, of equal keys and payloads, each get a record: all responses if theirs is the largest key. An empty table
    gives an empty manifest. Columns beside the three may have any name and are not written.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("uri"), body.alias("body"))
    mark = F.concat_ws(":", F.sha1(F.col("body").cast("binary")), F.octet_length("body"))
    copies = rows.select("id", mark.alias("mark")).groupBy("mark").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.select("mark", "last"), "copies")
    planned = rows.withColumn("mark", mark).join(copies, "mark", "left").select(
        "id", "uri", "body", F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, name, records, size, serial = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            columns = [b.column(c) for c in ("id", "uri", "body", "refers_to")]
            for i in range(b.num_rows):
                page, uri, text, refers = (c[i].as_py() for c in columns)
                if out is not None and size >= p.archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
                if out is None:
                    name, records, size, serial = f"{stem}-{serial:05d}.warc.gz", 0, 0, serial + 1
                    out = filesystem.open_output_stream(name, compression=None)
                to = None if refers is None else f"{ID_PREFIX}{refers}"
                data = member(record_bytes(f"{ID_PREFIX}{page}", uri, text.encode("utf-8", "replace"), to), p.level)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            names = [f"{folder.rstrip('/')}/{n.rpartition('/')[2]}" for n, _, _ in done]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([r for _, r, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], names=["path", "records", "bytes"]
            )

    return materialize(planned.mapInArrow(run, MANIFEST), "manifest")


class Source:
    """A window over bytes that are read in order: an archive's or a member's content. `parts(offset)`
    yields the bytes from there on; going back behind the window calls it again; `seeks` says that this costs nothing. `end` is where they end, once known."""

    def __init__(self, parts: Callable[[int], Iterator[bytes]], seeks: bool = True) -> None:
        self.parts, self.seeks, self.end = parts, seeks, None
        self.start(0)

    def start(self, offset: int) -> None:
        self.rest, self.data, self.at = self.parts(offset), bytearray(), offset

    def more(self) -> bool:
        part = next(self.rest, None)
        if not part:
            self.end = self.at + len(self.data)
            return False
        self.data += part
        return True

    def view(self, offset: int, size: int) -> bytes:
        """Up to `size` bytes from `offset`; fewer only at the end."""
        if offset < self.at:
            self.start(offset)
        while self.at + len(self.data) < offset + size and self.more():
            pass
        return bytes(self.data[offset - self.at : offset - self.at + size])

    def peek(self, offset: int, size: int) -> bytes | None:
        """Up to `size` bytes from `offset`, which may lie far ahead, without reading up to there; None if that can't be done."""
        if offset + size <= self.at + len(self.data):
            return self.view(offset, size)
        return next(self.parts(offset), b"")[:size] if self.seeks else None

    def drop_to(self, offset: int) -> None:
        """Forget what lies before `offset`."""
        if offset > self.at + len(self.data):
            self.view(offset, 0)
        if offset > self.at:
            del self.data[: offset - self.at]
            self.at = offset

    def find(self, marks: tuple[bytes, ...], offset: int, passing: bool = False, within: int | None = None) -> int:
        """The next offset at which one of `marks` begins, or -1; `passing` forgets what is searched. With `within` only so many
        bytes, and what was read with them, are searched."""
        longest = max(map(len, marks))
        last = None if within is None else offset + within
        if offset < self.at:
            self.start(offset)
        while True:
            found = [x for x in (self.data.find(m, offset - self.at) for m in marks) if x >= 0]
            if found:
                return self.at + min(found)
            offset = max(offset, self.at + len(self.data) - longest + 1)
            if last is not None and offset >= last:
                return -1
            if passing:
                self.drop_to(offset)
            if not self.more():
                return -1

    def size(self) -> int:
        """The offset behind the last byte."""
        while self.more():
            self.drop_to(self.at + len(self.data))
        return self.at + len(self.data)


class Damaged(Exception):
    pass


def _read_parts(stream, p: Params) -> Callable[[int], Iterator[bytes]]:
    def parts(offset: int) -> Iterator[bytes]:
        while True:
            stream.seek(offset)  # others read the same stream
            part = stream.read(p.read_bytes)
            if not part:
                return
            offset += len(part)
            yield part

    return parts


def _inflated(src: Source, at: int, p: Params) -> Iterator[tuple[bytes, int]]:
    """The content of the gzip member at `at` in pieces, each with the offset behind what was read for it. zlib
    checks its sums; the last offset lies behind the member."""
    d, size = zlib.decompressobj(31), 8 << 10
    while not d.eof:
        part = d.unconsumed_tail
        if not part:
            part = src.view(at, size)
            at, size = at + len(part), min(2 * size, p.read_bytes)
        try:
            out = d.decompress(part, p.read_bytes)
        except zlib.error as e:
            raise Damaged(f"bad member: {e}") from e
        if not part and not out and not d.eof:
            raise Damaged("member cut off")
        yield out, at - len(d.unused_data if d.eof else d.unconsumed_tail)


def _member_at(src: Source, at: int, p: Params) -> tuple[Source, int]:
    """The content of the member at `at`, once its checksum is verified, and the offset behind it."""
    held: list[bytes] | None = []
    size, end = 0, at
    for part, end in _inflated(src, at, p):
        size += len(part)
        if held is not None:
            held = [*held, part] if size <= p.held_bytes else None
        if held is None:
            src.drop_to(end)
    if held is not None:
        content = b"".join(held)
        return Source(lambda offset: iter([content[offset:]])), end

    def parts(offset: int) -> Iterator[bytes]:
        seen = 0
        for part, upto in _inflated(src, at, p):
            src.drop_to(upto)
            if seen + len(part) > offset:
                yield part[max(0, offset - seen) :]
            seen += len(part)

    return Source(parts, seeks=False), end


#: A version line is no longer than this, and a length has no more digits.
VERSION_BYTES, LENGTH_DIGITS = 64, 18


def _length(value: str) -> int | None:
    """A length in decimal digits; null for anything else."""
    return int(value) if value.isascii() and value.isdigit() and len(value) <= LENGTH_DIGITS else None


def _header(src: Source, at: int, p: Params) -> tuple[dict[str, str], int, int]:
    """Fields (lower-case names) of the record header at `at`, the block's length, and the offset behind the blank line. A
    header may have any number of lines; one of over `line_bytes`, or without a colon, ends the attempt, so that bytes which only
    begin like a record are not held up to some line's end far behind."""
    if not src.view(at, len(VERSION_MARK)).startswith(VERSION_MARK):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    first = True
    while True:
        end = src.find((b"\r\n",), at, within=VERSION_BYTES if first else p.line_bytes)
        if end < 0 or first and end - at > VERSION_BYTES:
            raise Damaged("no version line" if first else "header cut off")
        line, at = src.view(at, end - at), end + 2
        if first:
            first = False
            continue
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = _length(fields.get("content-length", ""))
    if length is None or "warc-type" not in fields:
        raise Damaged("no length or type")
    return fields, length, at


def _record_at(src: Source, at: int, p: Params, payloads: bool) -> tuple[dict, int]:
    """The record at `at`, with its payload digest verified, and the offset behind it. Without `payloads`
    the block passes through and only a read's worth is held. A length that leads behind the bytes' end, once this is
    known, is refused, and one behind which no record ends is too, both without reading there."""
    fields, length, at = _header(src, at, p)
    end, kind = at + length, fields["warc-type"]
    if src.end is not None and end > src.end:
        raise Damaged("block cut off")
    if (behind := src.peek(end, 4)) is not None and (behind not in (b"\r\n\r\n", b"") or not behind and src.peek(end - 1, 1) == b""):
        raise Damaged("block doesn't end where its length says")
    said, told = fields.get("warc-payload-digest", ""), None
    if fields.get("content-type", "").startswith("application/http"):
        gap = src.find((b"\r\n\r\n",), at, within=min(length, p.line_bytes))
        if gap < 0 or gap + 4 > end:
            raise Damaged("no http header")
        for line in src.view(at, gap - at).split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                told = _length(value.strip().decode("latin-1"))
        at = gap + 4
    sums, kept, size = hashlib.sha1(), [], end - at
    while at < end:
        part = src.view(at, min(p.read_bytes, end - at))
        if len(part) < min(p.read_bytes, end - at):
            raise Damaged("block cut off")
        sums.update(part)
        if payloads:
            kept.append(part)
        at += len(part)
        src.drop_to(at)
    if src.view(end, 4) not in (b"\r\n\r\n", b""):
        raise Damaged("block doesn't end where its length says")
    found = said.removeprefix("sha1:") if kind == "revisit" else base64.b32encode(sums.digest()).decode()
    if kind != "revisit" and said.startswith("sha1:") and said != f"sha1:{found}":
        raise Damaged("payload digest differs")
    clean = lambda x: x.strip("<>") if x else None
    return {
        "kind": "record", "record_id": clean(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": told if kind == "revisit" and told is not None else size, "payload_digest": found, "refers_to": clean(fields.get("warc-refers-to")),
        "payload": b"".join(kept) if payloads and kind != "revisit" else None,
    }, end + len(src.view(end, 4))


def _records_in(content: Source, p: Params, payloads: bool) -> Iterator[dict]:
    """The records of a member's content and, by their `content_offset`, the gaps between them."""
    at, gap_from, reason = 0, None, ""
    while True:
        content.drop_to(at)
        ended = not content.view(at, 1)
        if not ended:
            try:
                record, end = _record_at(content, at, p, payloads)
            except Damaged as e:
                if gap_from is None:
                    gap_from, reason = at, str(e)
                found = content.find((VERSION_MARK,), at + 1, passing=True)
                at = content.size() if found < 0 else found
                continue
        if gap_from is not None:
            yield {"kind": "gap", "content_offset": gap_from, "gap_bytes": at - gap_from, "reason": reason}
            gap_from = None
        if ended:
            return
        yield record | {"content_offset": at}
        at = end


def salvage(stream, p: Params = Params(), payloads: bool = True) -> Iterator[dict]:
    """Records (kind `record`) and gaps (kind `gap`, with gap_bytes and the reason) of an archive that can be
    sought in, in order. Together they cover each byte once; within a member of several records or with
    bytes that are none, `content_offset` tells where in its content. Members and plain records may alternate.
    An empty archive yields nothing."""
    src = Source(_read_parts(stream, p))
    at, gap_from, reason = 0, None, ""
    while True:
        src.drop_to(at)
        start = src.view(at, len(VERSION_MARK))
        found: Iterator[dict] = iter(())
        if start:
            try:
                if start.startswith(MEMBER_MARK):
                    content, end = _member_at(src, at, p)
                    found, held = _records_in(content, p, payloads), []
                    while not held or held[-1]["kind"] == "gap":  # a member without any record is no member
                        item = next(found, None)
                        if item is None:
                            raise Damaged(held[0]["reason"] if held else "empty member")
                        held.append(item)
                    found = chain(held, found)
                elif start.startswith(VERSION_MARK):
                    record, end = _record_at(src, at, p, payloads)
                    found = iter([record])
                else:
                    raise Damaged("neither member nor version line")
            except Damaged as e:
                if gap_from is None:
                    gap_from, reason = at, str(e)
                found_at = src.find((MEMBER_MARK, VERSION_MARK), at + 1, passing=True)
                at = src.size() if found_at < 0 else found_at
                continue
        if gap_from is not None:
            yield {"kind": "gap", "offset": gap_from, "gap_bytes": at - gap_from, "reason": reason}
            gap_from = None
        if not start:
            return
        for item in found:
            yield item | {"offset": at}
        at = end


def read_archives(spark: SparkSession, manifest: DataFrame, p: Params = Params(), payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives whose `path` the manifest lists (see `RECORDS`).

    An archive is streamed by one task; its memory is bounded by the longest payload, without `payloads` by a few
    reads and the longest header line. Archives with no bytes and empty manifests give no rows.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"offset": pa.int64(), "content_offset": pa.int64(), "payload_bytes": pa.int64(), "gap_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                filesystem, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with filesystem.open_input_file(name) as stream:
                    for r in salvage(stream, p, payloads):
                        rows.append(r | {"path": path})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(10_000, manifest.count()))).mapInArrow(run, RECORDS)


def quarantine(found: DataFrame) -> DataFrame:
    """The log of what a reader passed over: path, offset, content_offset, gap_bytes, reason."""
    return found.where("kind = 'gap'").select("path", "offset", "content_offset", "gap_bytes", "reason")


def page_records(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Write all pages, read the archives back, and return a row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    The records and the gaps between them are written beside the archives first. Gaps, or records that are not as
    many as the manifest names, mean that an archive was damaged in between: the job then fails and
    names the log. Repeated rows, nulls and other columns: see `write_archives`.
    """
    spark = pages.sparkSession
    manifest = write_archives(pages, new_path(spark, "warc"), p)
    found, path = written(read_archives(spark, manifest, p, payloads=False).drop("payload"), "warc-records")
    due = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    got = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    if got.get("gap") or got.get("record", 0) != due:
        raise RuntimeError(f"{got.get('record', 0)} of {due} records came back, with {got.get('gap', 0)} gaps; see {path}")
    number = lambda c: F.substring(c, len(ID_PREFIX) + 1, 30).try_cast("bigint")
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
