"""WARC archives: one gzip member per record, written by Spark's text sink, read in splits.

Writing. Each row of the sink is a member without its last byte, and the sink's line separator is that byte:
a gzip member ends with the high byte of its length, which is 0 for records of less than 16 MiB; a longer
record is followed by an empty member, which ends so too. The files are plain concatenated members.

Reading. Spark's text source is told that lines end with the gzip magic, so each task scans its byte range
for magic and gets the bytes behind each one that starts inside; the source reads past the range's end to
finish the last. A candidate is a record if its member inflates, checks and starts with a WARC header.
Compressed bytes may hold the magic by chance, so a member that doesn't end takes the candidates that follow
it. One that is cut so at the end of a range is put together with the first candidates of the next ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.shared import Tables

MAGIC = b"\x1f\x8b\x08"
LEVEL = 6
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
PAGE = "urn:x-page:"


def _member(record: bytes, level: int) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def row_of(record: bytes, level: int = LEVEL) -> bytes:
    """A record as a row for the sink, whose separator is the zero byte that the row lacks."""
    member = _member(record, level)
    if member[-1]:
        member += _member(b"", level)
    return member[:-1]


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC/1.1 record; fields that are None are left out, and line ends within values are escaped."""
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A page as a response, or as a revisit of another page: then the HTTP header alone, with the payload's length."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": digest,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<{PAGE}{refers_to}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record(fields, http if revisit else http + payload)


def with_revisits(pages: DataFrame) -> DataFrame:
    """`refers_to` for rows of `id`, `url`, `html`: of equal payloads the greatest id, for all rows with another id.

    It is null for responses: payloads that are short or single, and rows with the greatest id (repeated ones too).
    """
    sized = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("long_enough", F.octet_length("html") >= LEAST_BYTES)
    firsts = sized.where("long_enough").groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = sized.join(firsts, ["digest"], "left")
    again = F.col("long_enough") & F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    return joined.select("id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", level: int = LEVEL) -> None:
    """Every row as a record, in one archive per task, with a warcinfo record first. A null page is an empty one."""
    chosen = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:x-archive:pages>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
        yield pa.RecordBatch.from_arrays([pa.array([row_of(record(info, b"format: WARC File Format 1.1\r\n"), level)], pa.binary())], ["value"])
        for batch in batches:
            rows, held = [], 0
            for i, at, page, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                rows.append(row_of(page_record(i.as_py(), at.as_py(), page.as_py().encode(), first.as_py(), first.is_valid), level))
                held += len(rows[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    members = with_revisits(chosen).mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


@dataclass
class Record:
    """A record read back."""

    fields: dict[str, str]
    block: bytes


def parse_record(raw: bytes) -> Record | None:
    """An inflated member as a record, None if it is none or its block is cut off."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    try:
        n = int(fields.get("content-length", ""))
    except ValueError:
        return None
    return Record(fields, rest[:n]) if 0 <= n <= len(rest) else None


class MemberReader:
    """Members from candidates in file order: the bytes between one magic and the next."""

    def __init__(self):
        self.inflate, self.head, self.parts, self.raw = None, b"", [], []

    def _feed(self, candidate: bytes) -> bool:
        """Whether the open member may go on with this candidate: it inflates, and starts with a WARC header."""
        try:
            self.parts.append(self.inflate.decompress(MAGIC + candidate))
        except zlib.error:
            return False
        self.raw.append(candidate)
        if len(self.head) < 5:
            self.head = b"".join(self.parts)[:5]
        return b"WARC/".startswith(self.head)

    def take(self, candidate: bytes) -> Iterator[tuple[bool, bytes]]:
        """What is now known, in file order: (True, a member's content), or (False, a candidate that starts none).

        If a member turns out broken, its first candidate starts none and the others are taken again.
        """
        waiting = [candidate]
        while waiting:
            one = waiting.pop()
            if self.inflate is None:
                self.inflate, self.head, self.parts, self.raw = zlib.decompressobj(31), b"", [], []
            before = list(self.raw)
            if not self._feed(one):
                self.inflate = None
                yield False, (before or [one])[0]
                if before:
                    waiting += [one, *reversed(before[1:])]
            elif self.inflate.eof:
                self.inflate = None
                yield True, b"".join(self.parts)

    @property
    def open(self) -> list[bytes]:
        """The candidates of a member that has not ended."""
        return self.raw if self.inflate else []


READ_SCHEMA = "path string, block_start long, nth long, kind string, fields map<string,string>, block binary"


_KINDS = {"path": pa.string(), "block_start": pa.int64(), "nth": pa.int64(), "kind": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "block": pa.binary()}


def _columns(rows: list[tuple]) -> dict[str, pa.Array]:
    cols = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return {n: pa.array(list(c), k) for (n, k), c in zip(_KINDS.items(), cols, strict=True)}


def _row(place: tuple[str, int], nth: int, content: bytes) -> list[tuple]:
    found = parse_record(content)
    return [(*place, nth, "record", list(found.fields.items()), found.block)] if found else []


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range; also the candidates that may belong together across ranges: those before the
    range's first member, and those of a member that did not end."""
    reader, place, nth, leading, rows, held = MemberReader(), None, 0, True, [], 0
    for batch in batches:
        for data, path, start in zip(*(batch.column(k) for k in range(3)), strict=True):
            here = path.as_py(), start.as_py()
            if here != place:
                rows += [(*place, nth + 1 + k, "cut", None, c) for k, c in enumerate(reader.open)]
                reader, place, nth, leading = MemberReader(), here, 0, True
            nth += 1
            if nth == 1 and not place[1]:
                continue  # what stands before the file's first magic
            candidate = data.as_py()
            held += len(candidate)
            for whole, content in reader.take(candidate):
                if whole:
                    leading = False
                    rows += _row(place, nth, content)
                    held += len(content)
                elif leading:
                    rows.append((*place, nth, "cut", None, content))
            if held > 4 << 20:
                yield pa.RecordBatch.from_pydict(_columns(rows))
                rows, held = [], 0
    rows += [(*place, nth + 1 + k, "cut", None, c) for k, c in enumerate(reader.open)]
    yield pa.RecordBatch.from_pydict(_columns(rows))


def _rejoined(pieces: pa.Table) -> pa.Table:
    """The records of one file that ranges cut."""
    pieces = pieces.sort_by([("block_start", "ascending"), ("nth", "ascending")])
    reader, rows = MemberReader(), []
    for path, start, nth, candidate in zip(*(pieces[c].to_pylist() for c in ("path", "block_start", "nth", "block")), strict=True):
        for whole, content in reader.take(candidate):
            if whole:
                rows += _row((path, start), nth, content)
    return pa.table(_columns(rows))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `block_start`, `nth`, `fields` (names in lower case) and `block` of all records of gzipped archives.

    Bytes that are no member, members that don't check and members without a whole record give no row.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    found = lines.select(F.col("value").cast("binary").alias("b"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    parsed = found.mapInArrow(_parsed, READ_SCHEMA)
    cut = parsed.where("kind <> 'record'").groupBy("path").applyInArrow(_rejoined, READ_SCHEMA)
    return parsed.where("kind = 'record'").unionByName(cut).drop("kind")


PAGE_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, damaged boolean"


def pages_of(records: DataFrame) -> DataFrame:
    """The pages of response and revisit records, with the length and SHA-1 of their full payloads.

    A response's come from the payload as read, a revisit's from its stored header; `damaged` marks a
    response whose payload does not have the digest that its record states, null if that is no SHA-1. Numbers and digests
    that can't be read are null, so archives of other writers give rows too.
    """

    def sha1_of(value: str) -> str | None:
        text = value.strip().removeprefix("sha1:")
        if len(text) == 40 and not set(text.lower()) - set("0123456789abcdef"):
            return text.lower()
        try:
            raw = base64.b32decode(text, casefold=True)
        except ValueError:
            return None
        return raw.hex() if len(raw) == 20 else None

    def number(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(PAGE)
        return int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = []
            for fields, block in zip(batch.column(0), batch.column(1), strict=True):
                f, b = dict(fields.as_py()), block.as_py()
                if f.get("warc-type") not in ("response", "revisit"):
                    continue
                head, _, payload = b.partition(b"\r\n\r\n")
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                stated = sha1_of(f.get("warc-payload-digest", ""))
                revisit = f["warc-type"] == "revisit"
                digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                size = number(http.get(b"content-length", b"0").decode("latin-1")) if revisit else len(payload)
                rows.append((number(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, f["warc-type"], number(f.get("warc-refers-to")), stated and digest != stated))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PAGE_SCHEMA.split(", ")])

    return records.select("fields", "block").mapInArrow(run, PAGE_SCHEMA)


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All pages written to archives in the shared folder and read back; one row per input row.

    A null page is an empty payload, a null key stays null and is never referred to while another key has the
    same payload. Repeated rows with the greatest key are all responses. Extra columns are not read.
    """
    tables = Tables(pages.sparkSession)
    place = f"{tables.root}/archives"
    write_pages(pages, place, key, url, html)
    return pages_of(read_records(pages.sparkSession, place)).withColumnRenamed("page_id", key)
