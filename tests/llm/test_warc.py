import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from towerlens.llm import warc

PAGES = "page_id long, url string, html string, digest string, n int"


def pages(spark):
    random.seed(2)
    noise = ["".join(random.choices("abcdefgh <>", k=random.randrange(4000))) for _ in range(60)]
    same = "é" * 700
    rows = [(i, f"http://x/{i}", t, "d", 1) for i, t in enumerate(noise)]
    rows += [(100, None, same, None, None), (101, "http://x/a b", same, None, None), (101, "u", same, None, None)]
    rows += [(200, "u", "short", "", 0), (201, "u", "short", "", 0), (202, "u", None, "", 0), (None, "u", same, "", 0), (-5, "u", "", "", 0)]
    return spark.createDataFrame(rows, PAGES), rows


def plain(rows):
    out = []
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        keys = [k for k, _, h, *_ in rows if (h or "").encode() == body and k is not None]
        last = max(keys) if keys and len(body) >= 1000 else key
        kind = "response" if key == last else "revisit"
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), kind, None if key == last else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [700, 4096, 8 << 20])
def test_round_trip_over_splits(spark, tmp_path, split):
    frame, rows = pages(spark)
    folder = f"file://{tmp_path}/w"
    files = warc.write(frame, folder, file_bytes=20_000).collect()
    assert sum(f.records for f in files) == len(rows)
    got = warc.read(spark, folder, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
    assert len({(r.path, r.start) for r in got}) == len(rows)
    bodies = {(r.page_id, r.payload_digest): r.payload for r in got if r.payload is not None}
    for key, _, html, *_ in rows:
        data = (html or "").encode()
        assert bodies.get((key, hashlib.sha1(data).hexdigest()), data) == data


def test_files_are_plain_gzip_of_warc(spark, tmp_path):
    frame, rows = pages(spark)
    path = warc.write(frame.coalesce(1), f"file://{tmp_path}/w").collect()[0].path
    text = gzip.open(path).read()
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"WARC-Type: revisit" in text


def test_magic_inside_a_record_is_no_record(tmp_path):
    inner = warc.member(1, None, b"inner page")
    stored = warc.member(2, None, b"outer") + warc.member(3, None, b"\x1f\x8b\x08" * 50 + inner)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(stored)
    for step in (1, 7, 64, 10_000):
        found = []
        with pa.OSFile(str(path)) as file:
            for start in range(0, len(stored), step):
                found += [r["page_id"] for _, _, r in warc.RangeReader(file, start, start + step, len(stored)).records()]
        assert found == [2, 3]


def test_no_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.write(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read(spark, folder).count() == 0


def packed(*records):
    """One gzip member with records as other writers store them: (header lines, block)."""
    data = b""
    for lines, block in records:
        head = "\r\n".join(["WARC/1.0", *lines, f"content-length: {len(block)}"])
        data += head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


RANDOM_ID = "<urn:uuid:5e0dbb6c-1f0e-4b44-9d5c-0a4bb1d6c2aa>"
BIG = random.Random(8).randbytes(3 << 20)
OK_HEAD = b"HTTP/1.1 200 OK\r\nserver: x\r\n\r\n"


def foreign_archive():
    """(bytes, rows that must come out) of an archive by another hand."""
    http = "content-type: application/http;msgtype="
    sha = hashlib.sha1(b"<p>hi</p>").hexdigest()
    parts = [
        packed((["warc-type: warcinfo", "warc-record-id: " + RANDOM_ID, "Content-Type: application/warc-fields"], b"software: z\r\n")),
        packed((["WARC-TYPE: request", "WARC-Record-ID: <urn:x:1>", http + "request"], b"GET / HTTP/1.1\r\nHost: x\r\n\r\n")),
        packed((["warc-type:response", "warc-record-id:" + warc.record_id(7), "warc-target-uri: http://a/", http + "response"], OK_HEAD + b"<p>hi</p>")),
        packed((["warc-type: metadata", "x-note: one", "  and two", "warc-record-id: <urn:x:2>"], b"via: y\r\n\r\nmore")),
        packed((["warc-type: revisit", "warc-record-id: <urn:x:3>", "warc-refers-to: " + warc.record_id(7), http + "response"], OK_HEAD)),
        packed((["warc-type: revisit", f"warc-payload-digest: SHA1:{sha}", http + "response"], b"HTTP/1.1 200 OK\r\nCONTENT-LENGTH: 9\r\n\r\n")),
        packed((["warc-type: response", "warc-record-id: " + warc.record_id(8), http + "response"], OK_HEAD + BIG)),
        packed(*[(["warc-type: resource", f"warc-record-id: {warc.record_id(20 + i)}"], b"r%d" % i) for i in range(3)]),
    ]
    sums = [(None, "warcinfo", b"software: z\r\n"), (None, "request", b""), (7, "response", b"<p>hi</p>"),
            (None, "metadata", b"via: y\r\n\r\nmore"), (None, "revisit", None, None, 7), (None, "revisit", None, sha, None, 9),
            (8, "response", BIG), (20, "resource", b"r0"), (21, "resource", b"r1"), (22, "resource", b"r2")]
    return b"".join(parts), sums


def as_row(key, kind, body, digest=None, refers=None, size=None):
    if body is not None:
        digest, size = hashlib.sha1(body).hexdigest(), len(body)
    return key, kind, size, digest, refers


def rows_in(path, data, step):
    out = []
    with pa.OSFile(str(path)) as file:
        for start in range(0, len(data), step):
            for _, _, r in warc.RangeReader(file, start, start + step, len(data)).records():
                out.append((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]))
    return out


@pytest.mark.parametrize("step", [1 << 10, 100_000, 64 << 20])
def test_archives_of_other_writers(tmp_path, step):
    data, expected = foreign_archive()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    assert rows_in(path, data, step) == [as_row(*x) for x in expected]


def test_other_writers_through_spark(spark, tmp_path):
    data, expected = foreign_archive()
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc.gz").write_bytes(data)
    got = warc.read(spark, f"file://{tmp_path}", split_bytes=500_000).orderBy("start", "record_no").collect()
    assert [(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got] == [as_row(*x) for x in expected]
    assert got[0].record_id == RANDOM_ID and got[-1].record_no == 2
    assert bytes(got[6].payload) == BIG


def test_damage_is_one_row_and_the_rest_is_read(tmp_path):
    one, two = warc.member(1, None, b"first page" * 9), warc.member(2, None, b"second")
    unmeasured = zlib.compressobj(6, zlib.DEFLATED, 31)
    unmeasured = unmeasured.compress(b"WARC/1.0\r\nwarc-type: response\r\n\r\nx") + unmeasured.flush()
    path = tmp_path / "x.warc.gz"
    hurt = one[:-6] + bytes([one[-6] ^ 1]) + one[-5:]
    cases = {
        hurt + two: [None, 2],
        one + two[:-12]: [1, None],
        b"junk" + one + b"\0" * 50 + two + b"tail": [1, 2],
        unmeasured + two: [None, 2],
        gzip.compress(b"no archive") + two: [2],
        b"": [],
    }
    for data, keys in cases.items():
        path.write_bytes(data)
        for step in (7, 10_000):
            rows = rows_in(path, data, step)
            assert [r[0] for r in rows] == keys
            assert all((r[1] == "broken") == (r[0] is None) for r in rows)


def test_only_listed_files_are_read(spark, tmp_path):
    frame, rows = pages(spark)
    folder = f"file://{tmp_path}/w"
    files = warc.write(frame.coalesce(1), folder)
    files.write.parquet(f"{tmp_path}/files")
    (tmp_path / "w" / "part-000009-0000.warc.gz").write_bytes(warc.member(9, None, b"left by a lost attempt"))
    listed = spark.read.parquet(f"{tmp_path}/files")
    assert warc.read(spark, folder, files=listed).count() == len(rows)
    assert warc.read(spark, folder).count() == len(rows) + 1


def test_foreign_ids_and_digests():
    assert warc.key_of(None) is None and warc.key_of("<urn:x:1>") is None and warc.key_of(RANDOM_ID) is None
    assert [warc.key_of(warc.record_id(k)) for k in (None, 0, -5, 2**63 - 1)] == [None, 0, -5, 2**63 - 1]
    assert warc.sha1_hex("md5:abc") is None and warc.sha1_hex("sha1:??") is None and warc.sha1_hex(None) is None
