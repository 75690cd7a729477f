import base64
import gzip
import hashlib
import io
import json
import tempfile
import zlib
from pathlib import Path

import pytest

from callsight.llm import warc

from .cases import SMALL, multiset

ODD = [
    (1, "http://a", "<p>same</p>", "x"),
    (2, "http://b", "<p>same</p>", "x"),
    (2, "http://b", "<p>same</p>", "x"),  # a repeated row
    (3, None, None, "x"),
    (4, "http://d", "", "x"),
    (5, "http://e\r\nWARC-Type: revisit", "a\r\n\r\nContent-Length: 3\r\n\r\nb", "x"),
    (6, "http://f", "ü" * 3_000_000, "x"),
    (None, "http://g", "<p>same</p>", "x"),
    (None, "http://h", "alone", "x"),
]


def odd_pages(spark, rows=ODD):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def archived(spark, pages, **options):
    folder = tempfile.mkdtemp()
    written = warc.write_archives(pages, f"{folder}/found", **options)
    normalised = warc.normalise_archives(written, f"{folder}/found", f"{folder}/single")
    return folder, written, normalised, warc.read_archives(normalised, f"{folder}/single")


def expected(rows, least=0):
    last = {}
    for page, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            last[html or ""] = max(page, last.get(html or "", page))
    counts = [h or "" for _, h in rows]
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        to = last.get(html or "") if counts.count(html or "") > 1 else None
        to = None if to == page else to
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if to is None else "revisit", to))
    return out


def digests(read):
    return multiset(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert digests(archived(spark, pages)[3]) == multiset(expected(rows))


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_defined_cases(spark, least):
    read = archived(spark, odd_pages(spark), least=least, file_bytes=1 << 20)[3]
    assert digests(read) == multiset(expected([(p, h) for p, _, h, _ in ODD], least))


def test_empty_table(spark):
    assert archived(spark, odd_pages(spark, []))[3].count() == 0


def test_members_stand_alone_where_the_index_says(spark):
    folder, written, normalised, read = archived(spark, odd_pages(spark).coalesce(1))
    for r in written.collect():
        raw = Path(folder, "found", r.file).read_bytes()
        stream = zlib.decompressobj(31)
        stream.decompress(raw)
        assert stream.eof and not stream.unused_data  # the whole file is one member
    assert sum(r.records for r in normalised.collect()) == len(ODD)
    for r in normalised.collect():
        raw = Path(folder, "single", r.file).read_bytes()
        entries = [json.loads(x) for x in Path(folder, "single", r.file + ".idx").read_text().splitlines()]
        assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:i]) for i in range(len(entries))]
        assert sum(e["length"] for e in entries) == len(raw) == r.bytes
        for e in entries:
            fields, _ = warc.parse(gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]))
            assert fields["warc-type"] == e["type"] and fields["warc-target-uri"] == e["target"]
    assert {(r.file, r.offset) for r in read.collect()} == {(r.file, e["offset"]) for r in normalised.collect() for e in map(json.loads, Path(folder, "single", r.file + ".idx").read_text().splitlines())}


def test_streams_of_several_members_and_broken_ones():
    records = [warc.record(i, f"u{i}", b"x" * i * 1000, None) for i in range(5)]
    whole, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for raw in (whole, members):
        assert list(warc.Records(io.BytesIO(raw).read)) == records
    assert list(warc.Records(io.BytesIO(b"").read)) == []
    with pytest.raises(ValueError):
        list(warc.Records(io.BytesIO(whole[:-20]).read))
    with pytest.raises(ValueError):
        list(warc.Records(io.BytesIO(gzip.compress(records[2][:-500])).read))
