import gzip
import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from hyperloom.llm import media, warc


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4096, 4097, 64 * 64 * 3 + 5])
def test_mux_round_trip(n):
    payload = media.padded(random.Random(n).randbytes(n))
    file = media.mux(payload)
    (track,) = media.read_tracks(file)
    assert media.samples(file, track) == payload
    assert (track.codec, track.handler, len(track.sizes)) == ("raw ", "vide", len(payload) // 64)
    keys = track.keyframes()
    assert all(file[a:b] == payload[64 * 16 * i : 64 * 16 * i + 64] for i, (a, b) in enumerate(keys.tolist()))
    assert track.seconds == len(payload) / 64 / 25


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_other_layouts():
    payload = media.padded(b"x" * 300)
    file = media.mux(payload)
    for junk in (box(b"free", b"123"), struct.pack(">I4sQ", 1, b"skip", 20) + b"abcd"):
        # boxes that nobody knows, in front: offsets move by their size
        moved = bytearray(junk + file)
        at = moved.index(b"stco") + 12
        first = struct.unpack_from(">I", moved, at)[0]
        struct.pack_into(">I", moved, at, first + len(junk))
        (track,) = media.read_tracks(bytes(moved))
        assert media.samples(bytes(moved), track) == payload
    for cut in range(0, len(file) - len(payload), 7):
        with pytest.raises(media.MediaError):
            media.read_tracks(file[:cut])
    assert media.padded(b"") == bytes(64)


def test_text_as_media(spark):
    rows = [(1, "abc", 5), (2, None, 5), (3, "é" * 5000, 5), (1, "abc", 5)]
    got = media.text_as_media(spark.createDataFrame(rows, "doc_id long, text string, codec int")).collect()
    assert len(got) == 4
    for r in got:
        data = dict((k, t) for k, t, _ in rows)[r["doc_id"]] or ""
        payload = media.padded(data.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.text_as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(media.mux(bytes(64 * 40)))), (2, None), (3, bytearray(b"no media"))], "id long, content binary")
    got = {r["id"]: r for r in media.media_columns(df, "id", "content").collect()}
    assert got[1]["n_samples"] == 40 and len(got[1]["keyframes"]) == 3 and got[1]["error"] is None
    assert got[2]["error"] and got[3]["error"] and got[3]["keyframes"] == []


def test_records_in_small_ranges(spark, tmp_path):
    rng, want = random.Random(3), []
    with open(tmp_path / "a.bin", "wb") as f:
        for i in range(150):
            body = rng.randbytes(rng.randint(0, 300)) + b"".join(rng.choice([warc.MAGIC, warc.MAGIC + bytes(7), rng.randbytes(50)]) for _ in range(rng.randint(0, 12)))
            want.append((str(i), body))
            made = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that payloads show their magic
            f.write(made.compress(warc.record({"WARC-Type": "resource", "WARC-Record-ID": str(i)}, body)) + made.flush())
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("500", "3k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = sorted((r["fields"]["warc-record-id"], bytes(r["block"])) for r in warc.read_records(spark, str(tmp_path)).collect())
            assert got == sorted(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_damaged_archives(spark, tmp_path):
    good = gzip.compress(warc.record({"WARC-Type": "resource", "WARC-Record-ID": "a"}, b"1"), mtime=0)
    (tmp_path / "a").write_bytes(good + b"junk" + good[:-9] + good + gzip.compress(b"no record") + warc.MAGIC)
    assert warc.read_records(spark, str(tmp_path)).count() == 2


BIG = "p" * 1000


def test_pages(spark, tmp_path):
    rows = [(1, "http://a", BIG, 0), (5, "http://b\r\nX: y", BIG, 0), (3, None, BIG, 0), (4, "u", "p" * 999, 0), (6, "u", "p" * 999, 0), (7, "u", None, 0), (8, "é", "ü" * 500, 0), (None, "u", BIG, 0), (5, "again", BIG, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["damaged"]) for r in warc.archived_pages(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for k, _, t, _ in rows:
        again = t == BIG and k != 5
        want.append((k or -1, len((t or "").encode()), sha(t), "revisit" if again else "response", 5 if again else None, False))
    assert got == sorted(want)
    assert warc.archived_pages(df.limit(0)).count() == 0
    warc.write_pages(df, str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") >= len(rows) + 1 and b"\r\nX: y" not in whole


def test_member_that_ends_otherwise():
    row = warc.row_of(b"x" * (1 << 24))
    assert gzip.decompress(row + b"\0") == b"x" * (1 << 24)
    assert np.frombuffer(warc.row_of(b"a") + b"\0", np.uint8)[-1] == 0


def test_damaged_files_give_media_errors():
    deep = b""
    for _ in range(1200):
        deep = box(b"moov", deep)
    good = media.mux(media.padded(bytes(range(256)) * 40))
    at = good.index(b"stsz")
    huge = good[: at + 8] + struct.pack(">II", 64, 2**32 - 1) + good[at + 16 :]
    table = lambda kind, body: box(kind, b"\0" * 4 + body)
    falling = box(b"moov", box(b"trak", table(b"stsz", struct.pack(">II", 1, 4)) + table(b"stco", struct.pack(">III", 2, 0, 0)) + table(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 0, 2, 1))))
    fragments = box(b"moov", box(b"trak", b"")) + box(b"moof", box(b"traf", table(b"trun", b"")))
    for data in (deep, huge, falling, fragments, b"", b"\0" * 7):
        with pytest.raises(media.MediaError):
            media.read_tracks(data)
    rng = random.Random(5)
    for _ in range(400):
        raw = bytearray(good[: at + 200])
        for _ in range(rng.randint(1, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            media.read_tracks(bytes(raw) + good[at + 200 :])
        except media.MediaError:
            pass


@pytest.mark.parametrize(("bits", "raw"), [(4, b"\x12\x30"), (8, b"\x01\x02\x03"), (16, b"\0\1\0\2\0\3")])
def test_compact_sizes(bits, raw):
    table = lambda kind, body: box(kind, b"\0" * 4 + body)
    parts = table(b"stz2", struct.pack(">II", bits, 3) + raw) + table(b"stco", struct.pack(">II", 1, 4)) + table(b"stsc", struct.pack(">I3I", 1, 1, 3, 1))
    (track,) = media.read_tracks(box(b"moov", box(b"trak", parts)) + bytes(50))
    assert track.sizes.tolist() == [1, 2, 3] and track.starts.tolist() == [4, 5, 7]


def test_foreign_records(spark):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nabc"
    digest = hashlib.sha1(b"abc").hexdigest()
    rows = [
        ({"warc-type": "response", "warc-payload-digest": "sha256:xyz", "warc-record-id": "<urn:uuid:1>"}, body),
        ({"warc-type": "response", "warc-payload-digest": f"sha1:{digest.upper()}"}, body),
        ({"warc-type": "response", "warc-payload-digest": "sha1:" + "0" * 40}, body),
        ({"warc-type": "revisit", "warc-payload-digest": "md5:1"}, body),
        ({"warc-type": "warcinfo"}, b""),
    ]
    got = sorted((r["record_type"], r["payload_bytes"], r["payload_digest"], r["damaged"]) for r in warc.pages_of(spark.createDataFrame(rows, "fields map<string,string>, block binary")).collect() if r["damaged"] is not None)
    assert got == [("response", 3, digest, False), ("response", 3, digest, True)]
    assert warc.pages_of(spark.createDataFrame(rows, "fields map<string,string>, block binary")).count() == 4
