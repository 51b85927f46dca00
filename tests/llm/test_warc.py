import gzip
import hashlib
from pathlib import Path

import pytest

from twins import compare, connect
from wardlens.llm import warc


def expected(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = len(data) >= 100 and i is not None and first[h] < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a", None), (2, None, ""), (3, "http://b\r\nX: y", "é" * 49), (4, "u", "é" * 50), (5, "u", "é" * 50),
    (6, "u", "x" * 400_000), (7, "u", "é" * 33_000 + "z" * 70_000), (8, "u", "x" * 400_000),
    (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (11, "u", "a\n\r\n\r\n"), (12, "u", "\r\n" * 60),
    (13, "u", "WARC/1.1\r\n" * 11), (14, "u", "q" * 99 + "\r\n\r\nWARC/1.1"), (15, "u", "\r\nWARC/1.1\r\n"),
    (None, "u", "x" * 400_000),
]


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "warc")
    warc.write_archives(frame, path)
    chunks = warc.read_archives(spark, path)
    back = {}
    for r in sorted(chunks.collect(), key=lambda r: r.number):
        if r.record_type != "revisit":
            assert len(r.data) <= warc.SEGMENT
            back[r.page] = back.get(r.page, b"") + bytes(r.data)
    for i, _, html in PAGES:
        if i not in (5, 8):
            assert back[i] == (html or "").encode()
    text = b"".join(gzip.open(p).read() for p in Path(path).glob("*.gz"))
    assert all(gzip.open(p).read(10) in (b"WARC/1.1\r\n", b"") for p in Path(path).glob("*.gz"))
    assert b"WARC-Type: continuation" in text and b"WARC-Segment-Total-Length: 400000" in text
    found = warc.payloads(chunks).select("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(PAGES)


def test_repeated_rows(spark):
    big, mid = "y" * 200_000, "m" * 300
    pages = [
        (1, "u", big), (1, "u", big), (None, "u", big), (None, "u", big), (None, "v", "n" * 90_000), (2, "u", big), (2, "u", big),
        (3, "u", mid), (3, "u", mid), (3, "u", "o" * 80_000), (4, "u", mid), (4, "w", mid), (4, "u", big), (5, "u", "s"), (5, "u", "s"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.digest(frame).collect()), key=str) == expected(pages)


def test_empty_table(spark):
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damage_is_found():
    record = "WARC-Type: response\r\nPage-ID: 1\r\nContent-Length: 3\r\n\r\nabcd"
    with pytest.raises(ValueError, match="announced"):
        warc.parse_record(record)


def test_segments_end_between_characters():
    data = ("é" * 10 + "\r\n\r\nWARC/1.1\r\n" * 3).encode()
    parts = list(warc.segments(data, 7))
    assert b"".join(parts) == data and all(p.decode() and warc._SEPARATOR not in f"\r\n\r\n{p.decode()}\r\n\r\n" for p in parts)
    assert list(warc.segments(b"")) == [b""]


def test_query_equals_sql(spark, sf_dir):
    from wardlens.llm.queries import QUERIES, SQL

    assert compare(QUERIES["op2_warc"](spark, sf_dir), connect(sf_dir), SQL["op2_warc"]) is None
