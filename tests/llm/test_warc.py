import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from tessera.llm import warc


def pages():
    rng = random.Random(4)
    bodies = ["", None, "<p>ä€😀</p>", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "0\r\n\r\n", "x" * 70_000, "é" * 40_000, "\r\n\r\n" * 20_000]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(60)]
    return rows + [(100, None, "no url"), (101, "http://a b\r\nX: y/", "odd url"), (102, "u", "".join(rng.choice("\r\n ab") for _ in range(50_000))), (103, "u", "alone")]


def brute(rows, min_bytes=0):
    of = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        of.setdefault(payload, []).append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        kept = max(of[payload])
        first = len(payload) < min_bytes or i == kept
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else kept))
    return sorted(out, key=str)


COLUMNS = "page_id long, url string, html string"


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_round_trip(spark, least):
    got = warc.round_trip(spark.createDataFrame([(*r, "z") for r in pages()], COLUMNS + ", digest string"), least)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages(), least)


def test_payloads_and_files(spark, tmp_path):
    """The files hold plain records whose lengths are right, cut into segments that come back whole."""
    path = f"{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(pages(), COLUMNS), path, min_bytes=10**9, segment_bytes=777, chunk_bytes=100)
    data = [gzip.decompress(p.read_bytes()) for p in Path(path).glob("*.gz")]
    segments = 0
    for own in data:
        at = 0
        while at < len(own):
            head = own[at : (end := own.index(b"\r\n\r\n", at))].decode()
            assert head.startswith("WARC/1.1\r\nWARC-Type: ")
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            at = end + 4 + int(fields["Content-Length"])
            assert own[at : at + 4] == b"\r\n\r\n"
            at += 4
            segments += fields["WARC-Type"] == "continuation"
    assert segments > 100
    got = {r.record_id.split(":")[2]: bytes(r.payload).decode() for r in warc.captures(spark, path).collect()}
    assert got == {str(i): html or "" for i, _, html in pages()}


def test_broken_segments_have_no_payload(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "y" * 5000)], COLUMNS), path, segment_bytes=1000)
    records = warc.archive_records(spark, path, True)
    lost = records.filter("NOT (segment = 3 AND record_id LIKE '%page:1:%')")
    blocks = {r.record_id.split(":")[2]: r.block for r in warc.reassembled(lost).collect()}
    assert blocks["1"] is None and blocks["2"] is not None


def test_chunked_framing():
    for size in (1, 3, 100):
        assert warc.dechunked(b"".join(warc.chunked(b"hello\r\n0\r\n\r\n", size))) == b"hello\r\n0\r\n\r\n"
    assert warc.dechunked(b"5\r\nhel") is None and warc.dechunked(b"zz\r\n") is None
    assert warc.dechunked(b"5;x=1\r\nhello\r\n0\r\n\r\n") == b"hello"


def test_odd_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], COLUMNS)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(None, "u", "same"), (4, "v", "same"), (None, "w", "lone")], COLUMNS)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [("4", "response", "None"), ("None", "response", "None"), ("None", "revisit", "4")]


def test_repeated_large_rows(spark):
    """Rows of one page, and of none, with one payload in segments come back as often as they were written."""
    large, other = "x" * (warc.SEGMENT_BYTES + 1000), "y" * (3 * warc.SEGMENT_BYTES)
    own = [(7, "u", large)] * 3 + [(5, "v", large), (None, "w", large)] + [(None, "a", other), (None, "b", other), (None, "b", other)]
    got = warc.round_trip(spark.createDataFrame(own, COLUMNS)).collect()
    want = [("7", len(large), "response", "None")] * 3 + [("5", len(large), "revisit", "7"), ("None", len(large), "revisit", "7")] + [("None", len(other), "response", "None")] * 3
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
