import base64
import gzip
import hashlib
import json
import zlib

import pytest

from sheetstorm.llm.warc import archive_pages, normalise_file, read_index, read_records, record_bytes, write_archives

from .helpers import SF


def expected(rows, least=0):
    smallest = {}
    for page_id, payload in rows:
        if page_id is not None:
            smallest[payload] = min(page_id, smallest.get(payload, page_id))
    out = []
    for page_id, payload in rows:
        first = smallest.get(payload)
        revisit = first is not None and first != page_id and len(payload) >= least
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 10])
def test_odd_rows(spark, least):
    rows = [(3, "u", "same page"), (1, "u", "same page"), (1, "u", "same page"), (2, "a\r\nb", "<p>ü\r\n\r\nWARC/1.1</p>"), (4, None, None), (5, "u", ""), (None, "u", "same page"), (None, "u", "alone"), (9, "u", "y" * 300_000), (8, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = archive_pages(pages, least_bytes=least).collect()
    assert sorted(str(tuple(r)) for r in got) == expected([(i, (h or "").encode()) for i, _, h in rows], least)
    assert archive_pages(pages.limit(0)).count() == 0


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = archive_pages(pages).collect()
    assert sorted(str(tuple(r)) for r in got) == expected([(r.page_id, (r.html or "").encode()) for r in pages.collect()])


@pytest.mark.parametrize("count", [0, 499, 500, 1000])
def test_whole_batches_of_records(spark, count):
    docs = spark.range(0, count, 1, 1).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "concat('page ', id) AS html")
    rows = archive_pages(docs).collect()
    assert sorted(r.page_id for r in rows) == [*range(count)] and {r.record_type for r in rows} <= {"response"}


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>") for i in range(20)], "page_id long, url string, html string")
    files = write_archives(pages, f"{tmp_path}/raw").collect()
    assert sum(f.records for f in files) == 20
    for f in files:
        assert normalise_file(f"{tmp_path}/raw/{f.file}", f"{tmp_path}/out/{f.file}") == f.records
        whole = (tmp_path / "raw" / f.file).read_bytes()
        packed = (tmp_path / "out" / f.file).read_bytes()
        assert gzip.decompress(packed) == gzip.decompress(whole)  # the same records, in their order
        for line in map(json.loads, (tmp_path / "out" / f"{f.file}.index").read_text().splitlines()):
            member = zlib.decompress(packed[line["offset"] : line["offset"] + line["length"]], wbits=31)
            assert member.startswith(b"WARC/1.1\r\n") and line["id"].encode() in member
    found = read_records(read_index(spark, f"{tmp_path}/out"), f"{tmp_path}/out", with_payload=True).collect()
    assert {r.page_id: bytes(r.payload) for r in found if r.payload is not None} == {i: f"<p>{i}</p>".encode() for i in range(3)}
    assert {r.url for r in found} == {f"http://x/{i}" for i in range(20)}


def test_cut_off_stream(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record_bytes(1, "u", b"payload", None, "d"))[:-20])
    with pytest.raises((EOFError, zlib.error)):
        normalise_file(f"{tmp_path}/a.warc.gz", f"{tmp_path}/b.warc.gz")
    assert not list(tmp_path.glob("b.warc.gz"))
