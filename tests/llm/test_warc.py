import hashlib
from collections import defaultdict

import pytest

from guardlake.llm import warc
from guardlake.session import new_folder

PAGES = "page_id long, url string, html string"
LONG = "<p>é\r\n\r\nWARC/1.0\r\n</p>" * 3000


def plain(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups[data] if i is not None]
        top = max(ids) if len(data) >= 1000 and ids else page
        out.append((str(page), len(data), hashlib.sha1(data).hexdigest(),
                    "response" if page == top else "revisit", None if page == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, LONG), (4, "x" * 1000), (5, "x" * 1000), (6, "x" * 999),
            (7, "x" * 999), (8, LONG), (9, LONG + "!"), (5, "x" * 1000), (None, "y" * 2000),
            (10, "y" * 2000), (None, "z"), (11, "€" * 40000)]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}\r\nX: y", h)
                                   for i, h in rows], PAGES).selectExpr("*", "1 as payload")
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in warc.archived(pages).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert not warc.archived(pages.where("false")).collect()


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(i, "u", LONG[:n]) for i, n in enumerate(
        (0, 1, 4095, 4096, 4097, 60000))], PAGES)
    folder = new_folder(spark, "warc-test")
    warc.write_archives(warc.planned(pages), folder, segment_bytes=1000)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_pages(spark, folder).collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}
    records = warc.read_records(spark, folder)
    assert records.where("type = 'continuation'").count() > 50
    with pytest.raises(Exception, match="segments"):
        warc.reassembled(records.where("segment is null or segment <> 2")).collect()
    with pytest.raises(Exception, match="segments"):
        warc.reassembled(records.unionByName(records.where("segment = 3"))).collect()


def test_foreign_framing():
    body = b"4;name=value\r\nWiki\r\n0005\r\npedia\r\n0\r\nTrailer: x\r\n\r\n"
    assert warc.dechunked(body) == b"Wikipedia"
    with pytest.raises(ValueError):
        warc.dechunked(b"9\r\nshort\r\n0\r\n\r\n")
    record = (b"WARC/1.1\r\nwarc-type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
              b"WARC/1.0\r\nWARC-Type:metadata\r\nContent-Length:0\r\n\r\n\r\n\r\n")
    assert [(h["warc-type"], b) for h, b in warc.parsed(record)] == [
        ("response", b"abc"), ("metadata", b"")]
    with pytest.raises(ValueError):
        list(warc.parsed(record[:-4]))
