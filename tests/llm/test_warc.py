from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import pytest
from llm_texts import prose

from voxloom.llm import warc as wx
from voxloom.session import scratch_path

PAGES = "page_id long, url string, html string, payload string"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(record) + pack.flush()


def records(n=6):
    out = []
    for i in range(n):
        payload = (prose(i, 20 + 40 * i) + "\r\nWARC/1.0\r\n").encode()
        out.append(wx.make_record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None, False))
    return out


def read(data: bytes, chunk: int):
    found, gaps = [], []
    for start, end, record, reason in wx.salvage(io.BytesIO(data), chunk):
        if record is None:
            gaps.append((start, end, reason))
        else:
            found.append((start, end, int(record["record_id"].removeprefix("<urn:x-page:").removesuffix(">"))))
    return found, gaps


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
@pytest.mark.parametrize("pack", [member, bytes], ids=["gzip", "bare"])
def test_sound_archives_are_read_whole(chunk, pack):
    parts = [pack(r) for r in records()]
    found, gaps = read(b"".join(parts), chunk)
    assert gaps == [] and [f[2] for f in found] == list(range(6))
    assert [e - s for s, e, _ in found] == [len(p) for p in parts]


def damage(kind: str, part: bytes) -> bytes:
    middle = len(part) * 9 // 10  # inside the block: a header has no checksum of its own
    return {
        "flip": part[:middle] + bytes([part[middle] ^ 0x55]) + part[middle + 1 :],
        "cut": part[:middle],
        "noise": random.Random(3).randbytes(400) + b"\x1f\x8b\x08 WARC/1.1\r\n" + b"zz",
        "drop_start": part[5:],
        "zeros": bytes(len(part)),
    }[kind]


@pytest.mark.parametrize("chunk", [64, 1 << 20])
@pytest.mark.parametrize("kind", ["flip", "cut", "noise", "drop_start", "zeros"])
@pytest.mark.parametrize("pack", [member, bytes], ids=["gzip", "bare"])
@pytest.mark.parametrize("at", [0, 3, 5])
def test_later_records_are_recovered(chunk, kind, pack, at):
    parts = [pack(r) for r in records()]
    parts[at] = damage(kind, parts[at])
    found, gaps = read(b"".join(parts), chunk)
    lost = {at}
    assert [f[2] for f in found] == [i for i in range(6) if i not in lost]
    start = sum(map(len, parts[:at]))
    assert [(s, e) for s, e, _ in gaps] == [(start, start + len(parts[at]))]
    assert all(r for *_, r in gaps)


def test_every_byte_is_in_a_record_or_a_gap():
    draw = random.Random(5)
    data = bytearray(b"".join(pack(r) for r, pack in zip(records(12), [member, bytes] * 6)))
    for _ in range(25):
        data[draw.randrange(len(data))] ^= 1 << draw.randrange(8)
    found, gaps = read(bytes(data), 256)
    spans = sorted([(s, e) for s, e, _ in found] + [(s, e) for s, e, _ in gaps])
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_several_records_in_one_member():
    found, gaps = read(member(b"".join(records(3))) + member(records(4)[3]), 50)
    assert [f[2] for f in found] == [0, 1, 2, 3] and gaps == []
    assert read(b"", 10) == ([], [])


def many(n=10):
    return records(n)


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 20])
def test_one_damaged_record_of_a_member_costs_one_record(chunk):
    parts = many()
    for at in (0, 4, 9):
        block = bytearray(parts[at])
        block[len(block) * 9 // 10] ^= 1
        broken = member(b"".join([*parts[:at], bytes(block), *parts[at + 1 :]]))
        found, gaps = read(broken + member(records(11)[10]), chunk)
        assert [f[2] for f in found] == [i for i in range(11) if i != at]
        start = sum(map(len, parts[:at]))
        (gap,) = gaps
        assert gap[2].startswith("block digest differs") and gap[2].endswith(f"(inflated bytes {start} to {start + len(block)})")


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_a_false_length_in_a_member_costs_one_record(chunk):
    parts = many()
    for length in (b"3", b"999999999"):
        false = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: " + length + b"\r\n\r\nHTTP", parts[3])
        assert false != parts[3]
        found, gaps = read(member(b"".join([*parts[:3], false, *parts[4:]])), chunk)
        assert [f[2] for f in found] == [0, 1, 2, 4, 5, 6, 7, 8, 9] and len(gaps) == 1


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_a_truncated_member_gives_the_records_before_its_end(chunk):
    whole = member(b"".join(many()))
    found, gaps = read(whole[:-20], chunk)
    assert [f[2] for f in found][:9] == list(range(9)) and gaps[-1][:2] == (0, len(whole) - 20)
    # Cut in the middle, with another member after it.
    cut, after = whole[: len(whole) // 2], member(records(12)[11])
    found, gaps = read(cut + after, chunk)
    kept = [f[2] for f in found]
    assert kept[-1] == 11 and kept[:-1] == list(range(len(kept) - 1)) and len(kept) > 4
    assert gaps[-1][:2] == (0, len(cut))
    # A damaged byte in the compressed data: the records before it.
    flipped = bytearray(whole)
    flipped[len(whole) * 3 // 4] ^= 0xFF
    found, _ = read(bytes(flipped) + after, chunk)
    assert [f[2] for f in found][:5] == list(range(5)) and found[-1][2] == 11


def brute(rows):
    best = {}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            best[body] = max(best.get(body, i), i)
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        head = best.get(body)
        later = head is not None and (i is None or i < head)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if later else "response", head if later else None))
    return sorted(out, key=str)


def test_pages_go_through_archives(spark):
    big, other = prose(1, 400), "é" * 500 + "\r\n\r\n" + "x" * 10
    htmls = [big, other, big, "small", "small", None, "", big, other, prose(2, 60_000), big, big, "z" * 999, "z" * 999]
    rows = [(i * 7 % 97, f"http://x/{i}\r\nX: y" if i % 3 else None, h, "extra") for i, h in enumerate(htmls)]
    rows += [rows[0], rows[2], (None, None, big, None), (None, "u", prose(9, 300), None)]
    files = wx.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), scratch_path(spark, "warc"), wx.Archive(file_bytes=2000))
    assert files.count() > 3 and files.agg({"records": "sum"}).first()[0] == len(rows)
    got = wx.read_warc(files, wx.Archive(chunk=5000))
    assert got.where("reason is not null").count() == 0
    found = got.select(wx.page_of("record_id").alias("i"), "payload_bytes", "payload_digest", "type", wx.page_of("refers_to").alias("r"), "payload", "uri").collect()
    assert sorted([(f.i, f.payload_bytes, f.payload_digest, f.type, f.r) for f in found], key=str) == brute(rows)
    for f in found:
        body = bytes(f.payload)
        assert (body == b"") if f.type == "revisit" else hashlib.sha1(body).hexdigest() == f.payload_digest
        assert f.uri is None or "\r" not in f.uri
    listed = wx.read_warc(wx.archives(spark, files.first().path.rsplit("/", 1)[0]), payloads=False)
    assert listed.where("reason is null").count() == len(rows)


def test_damage_in_files_is_logged(spark, tmp_path):
    parts = [member(r) for r in records()]
    parts[2] = damage("flip", parts[2])
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"".join(records(2)))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = wx.read_warc(wx.archives(spark, str(tmp_path))).collect()
    gaps = [r for r in rows if r.reason is not None]
    assert len(rows) == 8 and len(gaps) == 1 and gaps[0].path.endswith("a.warc.gz")
    assert gaps[0].end - gaps[0].start == len(parts[2])


def test_no_pages(spark):
    files = wx.write_warc(spark.createDataFrame([], PAGES), scratch_path(spark, "warc"))
    assert files.collect() == [] and wx.read_warc(files).collect() == []
