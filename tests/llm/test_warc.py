"""WARC archives: round trip, roles, and the parser on its own."""

import base64
import glob
import gzip
import hashlib

import pytest

from careops.llm import warc
from careops.llm.common import scratch_path

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (9, "http://a/9", "same"),
        (3, None, ""), (4, "http://b", None), (5, "u\r\nv", "x\r\n\r\ny\r\n"), (6, "é", "<p>é 🙂</p>\r\n\r\n\r\n"),
        (None, "http://n", "same"), (None, None, "alone"), (7, "long", "z" * 3_000_000), (8, "w", "WARC/1.1\r\n\r\n"),
        (10, "q", "x\r\n\r\ny\r\n"), (11, "r", "\r\n"), (12, "s", "\r\n\r\n")]


def pages(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("payload", "record_type", "value", "payload_digest", "original")})


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = max(ids, default=None) if len(b) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(b), digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("file_bytes", [64_000_000, 20])
def test_round_trip(spark, least, file_bytes):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages(spark, ROWS), path, min_bytes=least, file_bytes=file_bytes)
    records = warc.read_archives(spark, path)
    got = warc.resolve_revisits(records.drop("payload")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, least)
    html = {(i, (h or "").encode()) for i, _, h in ROWS}
    for r in records.where("record_type = 'response'").collect():
        assert (r.page_id, bytes(r.payload)) in html
    urls = {r.page_id: r.url for r in records.collect()}
    assert urls[3] is None and urls[5] == "u%0D%0Av" and urls[6] == "é"


def test_files_are_warc(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages(spark, ROWS), path)
    records = []
    for name in glob.glob(path.removeprefix("file:") + "/*.gz"):
        parser = warc.RecordParser()
        data = gzip.open(name).read()
        for i in range(0, len(data), 997):
            records += parser.feed(data[i:i + 997])
        parser.close()
    assert len(records) == len(ROWS)
    for h, block in records:
        assert h["content-type"] == "application/http;msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n")
        if h["warc-type"] == "revisit":
            assert h["warc-profile"] == warc.PROFILE and h["warc-refers-to"].startswith("<urn:page:")
            assert block.endswith(b"\r\n\r\n")


def test_empty_and_damaged(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages(spark, []), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path, with_payload=False)).count() == 0
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.RecordParser().feed(good * 2)] == [b"ab", b"ab"]
    with pytest.raises(ValueError):
        list(warc.RecordParser().feed(good.replace(b": 2", b": 1")))
    with pytest.raises(ValueError):
        list(warc.RecordParser().feed(b"HTTP/1.1\r\n\r\n"))
    parser = warc.RecordParser()
    list(parser.feed(good[:-3]))
    with pytest.raises(ValueError):
        parser.close()
