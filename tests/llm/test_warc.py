from __future__ import annotations

import base64
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkveil.llm import warc
from sparkveil.llm.common import new_path


def sha(body):
    return base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", "WARC/1.1\r\n\x1f\x8b\x08"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.page_records(pages).collect()), key=repr)
    last = {}
    for i, _, body in rows:
        last[body or ""] = max(last.get(body or "", -1), -1 if i is None else i)
    expected = [(i, len((b or "").encode()), sha(b or ""), "response" if i == last[b or ""] else "revisit", None if i == last[b or ""] else last[b or ""]) for i, _, b in rows]
    assert got == sorted(expected, key=repr)
    assert warc.page_records(pages.limit(0)).count() == 0


def archive(n=20, compressed=True):
    rng = random.Random(1)
    parts = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 3000)))
        data = warc.record_bytes(f"urn:page:{i}", f"http://x/{i}", body, None)
        parts.append(warc.member(data, 6) if compressed else data)
    return parts


def read(data, p=warc.Params(read_bytes=701)):
    return list(warc.salvage(io.BytesIO(data), p))


def covers(found, size):
    """Records and gaps follow each other without holes."""
    at = 0
    found = [r for r in found if not r.get("content_offset")]
    for i, r in enumerate(found):
        assert r["offset"] == at
        at = found[i + 1]["offset"] if i + 1 < len(found) else size
        if r["kind"] == "gap":
            assert r["gap_bytes"] == at - r["offset"]


def test_intact():
    for compressed in (True, False):
        parts = archive(compressed=compressed)
        found = read(b"".join(parts))
        assert [r["record_id"] for r in found] == [f"urn:page:{i}" for i in range(20)]
        covers(found, sum(map(len, parts)))
    assert read(b"") == []


def test_salvages_behind_damage():
    for compressed in (True, False):
        parts = archive(compressed=compressed)
        broken = bytearray(parts[5])
        broken[len(broken) // 2] ^= 0xFF
        data = b"".join([*parts[:5], bytes(broken), *parts[6:12], parts[12][:40], *parts[13:]])
        found = read(data)
        ids = [r["record_id"] for r in found if r["kind"] == "record"]
        assert ids == [f"urn:page:{i}" for i in range(20) if i not in (5, 12)]
        gaps = [r for r in found if r["kind"] == "gap"]
        assert [g["gap_bytes"] for g in gaps] == [len(broken), 40]
        covers(found, len(data))


def test_random_damage_never_loses_untouched_records():
    rng = random.Random(4)
    for _ in range(30):
        parts = [bytearray(x) for x in archive(12, rng.random() < 0.7)]
        hurt = {i for i in range(12) if rng.random() < 0.3}
        for i in hurt:
            kind = rng.randrange(3)
            if kind == 0:
                parts[i][rng.randrange(len(parts[i]))] ^= 1 << rng.randrange(8)
            elif kind == 1:
                del parts[i][rng.randrange(1, len(parts[i])) :]
            else:
                parts[i][:] = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 500)))
        data = b"".join(map(bytes, parts))
        found = read(data)
        ids = {int(r["record_id"].rpartition(":")[2]) for r in found if r["kind"] == "record"}
        assert ids >= {i for i in range(12) if i not in hurt}
        covers(found, len(data))


def test_archives_on_spark(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("body "), (F.col("id") % 100).cast("string")).alias("html"))
    manifest = warc.write_archives(pages, new_path(spark, "t"), warc.Params(archive_bytes=4000))
    assert manifest.agg(F.sum("records")).first()[0] == 300 and manifest.count() > 3
    found = warc.read_archives(spark, manifest)
    assert found.where("kind = 'gap'").count() == 0
    assert found.where("record_type = 'response'").count() == 100
    assert found.where("record_type = 'response' and payload is null").count() == 0
    assert warc.read_archives(spark, manifest.limit(0)).count() == 0


def test_several_records_in_a_member():
    """All of them come out, whatever is held; what is no record in between is a gap of the content."""
    parts = archive(12, compressed=False)
    content = b"".join([*parts[:5], b"no record" * 99, *parts[5:11], parts[11][:-30]])
    data = b"".join([warc.member(content, 6), *archive(3)])
    for p in (warc.Params(read_bytes=701), warc.Params(read_bytes=701, held_bytes=100)):
        found = read(data, p)
        assert [r["record_id"] for r in found if r["kind"] == "record"] == [f"urn:page:{i}" for i in [*range(11), 0, 1, 2]]
        gaps = [(r["content_offset"], r["gap_bytes"]) for r in found if r["kind"] == "gap"]
        start = sum(map(len, parts[:5]))
        assert gaps == [(start, 9 * 99), (len(content) - len(parts[11]) + 30, len(parts[11]) - 30)]
        covers(found, len(data))


def test_long_records_and_headers():
    """No length is too long: a record beyond any buffer, a header of 70 KB, plain and in members."""
    body, url = random.Random(3).randbytes(300_000), "http://x/" + "u" * 70_000
    for compressed in (True, False):
        parts = [warc.record_bytes(f"urn:page:{i}", url, body, None) for i in range(3)]
        data = b"".join(warc.member(x, 1) if compressed else x for x in parts)
        for payloads in (True, False):
            found = list(warc.salvage(io.BytesIO(data), warc.Params(read_bytes=4096, held_bytes=8192), payloads))
            assert [(r["kind"], r["payload_bytes"], r["target_uri"] == url) for r in found] == [("record", 300_000, True)] * 3
            assert all(r["payload"] == (body if payloads else None) for r in found)
            assert found[0]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_a_damaged_archive_fails_the_query(spark, monkeypatch):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("body "), "id").alias("html"))
    folder = new_path(spark, "t")
    manifest = warc.write_archives(pages, folder)
    path = manifest.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    log = warc.quarantine(warc.read_archives(spark, manifest)).collect()
    assert len(log) == 1 and log[0].gap_bytes > 0 and log[0].reason
    monkeypatch.setattr(warc, "write_archives", lambda *_: manifest)
    with pytest.raises(RuntimeError, match="39 of 40"):
        warc.page_records(pages)


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-1", "1e3", "١٢", "", "9" * 18, "10000000000000000000"])
def test_a_length_that_is_none_is_a_gap(length):
    parts = archive(4, compressed=False)
    head, _, rest = parts[1].partition(b"\r\n\r\n")
    broken = re.sub(rb"Content-Length: \d+$", f"Content-Length: {length}".encode(), head) + b"\r\n\r\n" + rest
    for hurt in (broken, parts[1].replace(b"Content-Length: ", b"Content-Length: \xb2", 1)):
        data = b"".join([parts[0], hurt, *parts[2:]])
        for whole in (data, warc.member(data, 1)):
            found = read(whole)
            assert [r["record_id"] for r in found if r["kind"] == "record"] == [f"urn:page:{i}" for i in (0, 2, 3)]
            covers(found, len(whole))


def test_any_header_bytes_give_gaps():
    """Headers with bytes, lines and fields changed at random: no exception, and whole records behind them come back."""
    rng = random.Random(8)
    for _ in range(300):
        parts = archive(5, compressed=False)
        head, _, rest = parts[2].partition(b"\r\n\r\n")
        head = bytearray(head)
        for _ in range(rng.randrange(1, 6)):
            kind, at = rng.randrange(4), rng.randrange(len(head))
            if kind == 0:
                head[at] = rng.randrange(256)
            elif kind == 1:
                del head[at : at + rng.randrange(1, 30)]
            elif kind == 2:
                head[at:at] = rng.choice([b"\r\n", b"\r\n\r\n", b":", "²".encode(), b"\xff\xfe", b"WARC/1.1\r\n", b"Content-Length: 99999999999\r\n"])
            else:
                head[at:at] = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 50)))
            if not head:
                break
        data = b"".join([*parts[:2], bytes(head), b"\r\n\r\n", rest, *parts[3:]])
        for p in (warc.Params(read_bytes=701), warc.Params()):
            found = list(warc.salvage(io.BytesIO(data), p))
            ids = [r["record_id"] for r in found if r["kind"] == "record"]
            assert set(ids) >= {f"urn:page:{i}" for i in (0, 1)} and ids[-1] == "urn:page:4", head
            covers(found, len(data))


class Counted(io.BytesIO):
    got = 0

    def read(self, size=-1):
        out = super().read(size)
        self.got += len(out)
        return out


@pytest.mark.parametrize("length", [10**17, 150_000, 99_999])
def test_false_lengths_cost_no_reading_to_the_end(length):
    """Thousands of records with lengths far ahead: each is refused by what stands there."""
    bad = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nx\r\n\r\n".encode()
    data = b"".join([bad * 3000, *archive(3, compressed=False)])
    stream = Counted(data)
    found = list(warc.salvage(stream, warc.Params(read_bytes=1 << 12)))
    assert [r["record_id"] for r in found if r["kind"] == "record"] == [f"urn:page:{i}" for i in range(3)]
    covers(found, len(data))
    assert stream.got < 40 * len(data) + 3000 * (3 << 12)


def test_what_only_begins_like_a_record_is_not_held():
    noise = (b"WARC/1.0" + b"a:" * 200_000) * 5
    found = list(warc.salvage(io.BytesIO(noise + archive(1, compressed=False)[0]), warc.Params(read_bytes=4096, line_bytes=65_536)))
    assert [r["kind"] for r in found] == ["gap", "record"]
    src = warc.Source(lambda offset: iter([noise[offset : offset + 4096]] if offset == 0 else []))
    with pytest.raises(warc.Damaged):
        warc._header(src, 0, warc.Params())
    assert len(src.data) <= 8192
