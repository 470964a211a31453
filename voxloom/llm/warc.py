"""WARC archives: a writer with revisit records, and a salvage reader.

The writer makes one gzip member per record, so that a damaged record does not take
its neighbours along.  The reader checks everything it can: the member's checksum,
the version line, the header, the block's length and digest, the payload's digest.
After a failed check it searches for the next place where a member or a version
line begins a record that passes, goes on from there, and logs the bytes between as
a quarantined gap.

Files are written and read as streams by tasks, through ``pyarrow.fs``, under the
folder given (any URI that it knows, or a local path in tests).  A task's files
carry the number of its attempt, and only the files of attempts that Spark
committed are in the returned list, so retries leave no doubles.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, checked_join, salted_join, stored

BLOCK_BYTES = 8_000_000
# Fixed values of the format.
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
LOOK = 1 << 16  # inflated bytes among which a member of records has a version line
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


@dataclass(frozen=True)
class Archive:
    """Least payload bytes of a revisit; compressed bytes after which a file ends; gzip level; bytes
    that the reader fetches at once."""

    least_revisit: int = 1000
    file_bytes: int = 64_000_000
    level: int = 1
    chunk: int = 1 << 20


# ---------------------------------------------------------------- records


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def digest_label(hexadecimal: str) -> str:
    return "sha1:" + b32encode(bytes.fromhex(hexadecimal)).decode()


def label_digest(label: str | None) -> str | None:
    """Hexadecimal form of a ``sha1:`` label in base 32 or hexadecimal, or None."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return b32decode(value.upper()).hex()
    except ValueError:
        return None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit of another page's response without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": page_urn(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest_label(digest),
        "WARC-Block-Digest": digest_label(hashlib.sha1(block).hexdigest()),
    }
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": page_urn(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Damaged(Exception):
    """A check failed; the message says which."""


class Truncated(Damaged):
    """The data ends inside the record."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where it ends.  Raises ``Damaged``."""
    match = VERSION.match(data, at)
    if not match:
        raise (Truncated if len(data) - at < 10 and b"WARC/1.1\r\n".startswith(data[at:]) else Damaged)("no version line")
    stop = data.find(b"\r\n\r\n", match.end() - 2)
    if stop < 0:
        raise Truncated("header without end")
    head = {}
    for line in data[match.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise Damaged("no content length")
    first = stop + 4
    end = first + int(head["content-length"])
    if len(data) < end + 4:
        raise Truncated("block without end")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("wrong content length")
    block = data[first:end]
    stated = label_digest(head.get("warc-block-digest"))
    if stated and hashlib.sha1(block).hexdigest() != stated:
        raise Damaged("block digest differs")
    kind = head.get("warc-type", "")
    payload, size = block, None
    if head.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("HTTP header without end")
        length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", http)
        size = int(length[1]) if length else None
    digest = label_digest(head.get("warc-payload-digest"))
    if kind == "revisit":
        size = len(payload) if size is None else size
    else:
        actual = hashlib.sha1(payload).hexdigest()
        if digest and actual != digest:
            raise Damaged("payload digest differs")
        digest, size = actual, len(payload)
    record = {
        "type": kind, "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"),
        "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }
    return record, end + 4


# ---------------------------------------------------------------- salvage


class _Window:
    """A sliding part of a stream; offsets are the file's."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk, self.base, self.data, self.ended = stream, chunk, 0, b"", False

    def more(self) -> bool:
        """Fetch at least as much as is held, so that a long record is fetched in few steps."""
        if not self.ended:
            new = self.stream.read(max(self.chunk, len(self.data)))
            self.ended = not new
            self.data += new
        return not self.ended

    def forget(self, offset: int) -> None:
        self.data = self.data[offset - self.base :]
        self.base = offset


class Broken(Damaged):
    """A member that does not inflate to its end; what its sound part held, and the gaps in that."""

    def __init__(self, reason: str, records: list[dict], gaps: list[str]):
        super().__init__(reason)
        self.records, self.gaps = records, gaps


def _sound_part(raw: bytes) -> bytes:
    """What a broken member inflates to before its error, but for a few bytes."""
    inflate, parts = zlib.decompressobj(31), []
    try:
        for at in range(0, len(raw), 16):
            parts.append(inflate.decompress(raw[at : at + 16]))
    except zlib.error:
        pass
    return b"".join(parts)


def _inflate(window: _Window, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` inflates to, where it ends, and why it broke off if it did."""
    inflate = zlib.decompressobj(31)
    parts, fed = [], at
    try:
        while not inflate.eof:
            if fed == len(window.data) and not window.more():
                return b"".join(parts), window.base + fed, "member without end"
            piece = window.data[fed : fed + window.chunk]
            fed += len(piece)
            parts.append(inflate.decompress(piece))
            if len(parts) == 1 and len(parts[0]) >= LOOK and not VERSION.search(parts[0]):
                raise Damaged("member without version line")
    except zlib.error as error:
        return _sound_part(window.data[at:fed]), window.base + fed, f"member: {str(error).split(':')[0].lower()}"
    return b"".join(parts), window.base + fed - len(inflate.unused_data), None


def _inner_records(data: bytes) -> tuple[list[dict], list[str]]:
    """The records of a member's data that pass, and the gaps between them, with their places in that data.

    After one that fails, the search goes on at the next version line inside the member.
    """
    place, records, gaps = 0, [], []
    while place < len(data):
        try:
            record, place = parse_record(data, place)
            records.append(record)
        except Damaged as error:
            found = VERSION.search(data, place + 1)
            stop = found.start() if found else len(data)
            if gaps and gaps[-1][1] == place:  # one gap, whatever false starts lie in it
                gaps[-1][1] = stop
            else:
                gaps.append([place, stop, str(error)])
            place = stop
    return records, [f"{reason} (inflated bytes {start} to {stop})" for start, stop, reason in gaps]


def _read_unit(window: _Window, offset: int) -> tuple[list[dict], list[str], int]:
    """The records of the member, or the bare record, at ``offset``, the gaps inside it, and where it ends."""
    at = offset - window.base
    while len(window.data) - at < 10 and window.more():
        pass
    if window.data[at : at + 3] != MEMBER:
        while True:
            try:
                record, end = parse_record(window.data, at)
                return [record], [], window.base + end
            except Truncated:
                if not window.more():
                    raise
    data, end, broken = _inflate(window, at)
    records, gaps = _inner_records(data)
    if broken is not None:
        raise Broken(broken, records, gaps)
    if not records:
        raise Damaged(gaps[0] if gaps else "empty member")
    return records, gaps, end


def salvage(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """``(start, end, record, None)`` of every record that passes and ``(start, end, None, reason)`` of every
    gap, in the order of a readable stream.

    Holds one record (or member), one fetch and what a search looks ahead.  Of a
    member of several records those that pass are kept, whatever became of the
    others: gaps inside a member begin and end at its start, and their reason says
    which of its inflated bytes they are.  A member that does not inflate to its end
    gives the records before that; they begin and end at its start too, and its
    bytes, of which nothing tells where they end, are a gap.
    """
    window = _Window(stream, chunk)
    offset, gap, reason = 0, None, None
    while True:
        window.forget(min(offset, window.base + len(window.data)))
        if not window.data and not window.more():
            break
        try:
            records, inner, end = _read_unit(window, offset)
        except Damaged as error:
            if isinstance(error, Broken) and error.records:
                if gap is not None:
                    yield gap, offset, None, reason
                    gap = None
                for record in error.records:
                    yield offset, offset, record, None
                for told in error.gaps:
                    yield offset, offset, None, told
            if gap is None:
                gap, reason = offset, str(error)
            # The next place that may begin a record; three bytes may straddle a fetch.
            search = offset + 1
            while True:
                found = _START.search(window.data, search - window.base)
                if found:
                    offset = window.base + found.start()
                    break
                search = max(search, window.base + len(window.data) - 9)
                if not window.more():
                    offset = window.base + len(window.data)
                    break
                window.forget(search)
            continue
        if gap is not None:
            yield gap, offset, None, reason
            gap = None
        for told in inner:
            yield offset, offset, None, told
        for record in records:
            yield offset, end, record, None
        offset = end
    if gap is not None:
        yield gap, offset, None, reason


# ---------------------------------------------------------------- Spark


def _storage(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """``(none, id, digest, refers_to)`` of the pages whose payload a page of larger id has too.

    Digests are counted before they meet their pages again, and that join is
    salted, so a payload on a third of all pages is no one task's.
    """
    html = F.coalesce("html", F.lit(""))
    narrow = stored(
        pages.select(F.col("page_id").alias("id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
        .where(F.col("size") >= how.least_revisit)
        .select("id", "digest"),
        "digests",
    )
    heads = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("m")).where("m > 1").drop("m")
    both = salted_join(narrow, heads, "digest", "inner", spread=F.xxhash64("id"))
    later = F.col("refers_to").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("refers_to")))
    return both.where(later).select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, how: Archive = Archive()) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; returns the stored list of files, ``(path, records, bytes)``.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the
    largest id is a response, the others are revisits of it; smaller ones are all
    responses.  Null html is an empty payload, a null url leaves its field out.  Pages
    without an id count as smaller than any; if none of a group has one, all are
    responses.  Rows that repeat are each written; those with the largest id are all
    responses.  An empty table writes no files.  Other columns are ignored.
    """
    found = stored(revisits(pages, how), "revisits")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("id"),
        F.sha1(html.cast("binary")).alias("digest"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    rows = checked_join(rows, found, ["none", "id", "digest"], "left", spread=F.col("spread"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        storage, base = _storage(folder)
        storage.create_dir(base, recursive=True)
        out, path, done, count, size = None, None, [], 0, 0
        for batch in batches:
            for part in blocks(batch, "html", BLOCK_BYTES) if batch.num_rows else ():
                for page_id, url, text, digest, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    record = make_record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, refers_to, refers_to is not None)
                    pack = zlib.compressobj(how.level, wbits=31)
                    member = pack.compress(record) + pack.flush()
                    if out is None:
                        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                        out, count, size = storage.open_output_stream(path, compression=None), 0, 0
                    out.write(member)
                    count, size = count + 1, size + len(member)
                    if size >= how.file_bytes:
                        out.close()
                        done.append((path, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        names = [p.removeprefix(base).lstrip("/") for p, _, _ in done]
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{folder.rstrip('/')}/{n}" for n in names], "records": [c for _, c, _ in done], "bytes": [s for *_, s in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    sent = rows.select("page_id", "url", "html", "digest", "refers_to")
    return stored(sent.mapInArrow(write, "path string, records long, bytes long"), "archives")


RECORD = (
    "path string, start long, end long, reason string, type string, record_id string, uri string, date string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes)`` of the files of a folder that something else wrote."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))


def read_warc(files: DataFrame, how: Archive = Archive(), payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the files in ``files(path)``; a gap has a ``reason`` and no record.

    Compressed and bare records may alternate in a file.  Files are dealt over the
    tasks and read as streams; an empty file has neither records nor gaps.  Without
    ``payloads`` they are checked but not returned.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                storage, place = _storage(path)
                rows, held = [], 0
                with storage.open_input_stream(place, compression=None) as stream:
                    for start, end, record, reason in salvage(stream, how.chunk):
                        row = (record or {}) | {"path": path, "start": start, "end": end, "reason": reason}
                        if not payloads:
                            row["payload"] = None
                        held += len(row.get("payload") or b"") + 300
                        rows.append({c: row.get(c) for c in names})
                        if held >= BLOCK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(spread).mapInArrow(read, RECORD)


def page_of(urn: str) -> Column:
    """The page id of a record id, natively; null for none."""
    value = F.regexp_extract(urn, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(value != "", value.cast("long"))
