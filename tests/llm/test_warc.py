import io

import pytest

from snapsift.functions.runtime import scratch_path
from snapsift.llm import warc as w


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a/\r\nX: y", "same", "x"), (2, None, "same", "x"), (3, "http://b", None, "x"), (4, "http://c", "", "x"), (5, "u", "é" * 700_000, "x"),
        (6, "u", "lonely\r\n\r\nWARC/1.1\r\n", "x"), (7, "u", "same", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def read(spark, pages, **options):
    return w.read_archives(w.write_archives(pages, scratch_path(spark, "warc"), **options))


def test_like_sql(spark, pages, in_duckdb, same_rows):
    rows = read(spark, pages).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").toPandas()
    same_rows(rows, in_duckdb(w._SQL, pages=pages.toPandas()))


def test_round_trip_in_chunks(spark, pages):
    chunks = read(spark, pages).orderBy("page_id", "chunk_no").collect()
    payloads = {}
    for r in chunks:
        payloads[r.page_id] = payloads.get(r.page_id, b"") + (r.payload or b"")
    given = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert payloads == given | {1: b"", 2: b"", 3: b""}
    assert [(r.chunk_no, r.is_last, r.payload_bytes) for r in chunks if r.page_id == 5] == [(0, False, 1 << 20), (1, True, 1_400_000)]
    assert {r.page_id: r.url for r in chunks}[1] == "http://a/%0D%0AX:%20y"


def test_small_payloads_and_repeats(spark, pages):
    kept = read(spark, pages, least_bytes=5).filter("record_type = 'revisit'")
    assert kept.count() == 0
    odd = pages.union(pages.filter("page_id = 7")).union(pages.filter("page_id = 1").selectExpr("cast(null as long)", "url", "html", "payload"))
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in read(spark, odd).filter("payload_bytes = 4").collect())
    assert got == [("1", "revisit", 7), ("2", "revisit", 7), ("7", "response", None), ("7", "response", None), ("None", "revisit", 7)]


def test_damage_is_noticed():
    out = io.BytesIO()
    w.ArchiveWriter(out).write(1, "u", memoryview(b"payload"), None)
    assert [r["payload"] for r in w.read_archive(io.BytesIO(out.getvalue()))] == [b"payload"]
    import gzip

    raw = gzip.decompress(out.getvalue()).replace(b"payload\r\n", b"paxload\r\n")
    with pytest.raises(ValueError, match="digest"):
        list(w.read_archive(io.BytesIO(gzip.compress(raw))))


def test_empty(spark, pages):
    assert read(spark, pages.limit(0)).count() == 0
