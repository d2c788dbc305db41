import hashlib

from pagefold.llm import warc
from pagefold.llm.common import scratch

ROWS = [(3, "http://a/3", "x" * 200), (1, "http://a/1", "x" * 200), (2, None, "short"), (5, "http://a/\r\nX: 5", "short"), (4, "http://a/4", None), (None, "http://a/n", "x" * 200), (1, "http://a/1", "x" * 200), (7, "http://a/7", "é" * 100_000), (8, "u", "")]
DDL = "page_id long, url string, html string, digest string"


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and (page is None or page > first)
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], DDL).repartition(3)
    folder = scratch(spark, "t")
    index = warc.write_archives(df, folder, archive_bytes=300)
    assert index.count() == len(ROWS)
    got = [tuple(r) for r in warc.read_records(index, folder).select("page_id", "payload_bytes", "digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(ROWS)


def test_selected_records_only(spark):
    folder = scratch(spark, "t")
    index = warc.write_archives(spark.createDataFrame([(*r, "c") for r in ROWS], DDL), folder)
    rows = warc.read_records(index.where("page_id = 7"), folder).collect()
    assert [bytes(r.payload).decode() for r in rows] == ["é" * 100_000]
    assert rows[0].url == "http://a/7"


def test_empty(spark):
    folder = scratch(spark, "t")
    index = warc.write_archives(spark.createDataFrame([], DDL), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_ranges_join_near_reads():
    rows = [{"file": "a", "offset": o, "length": 10} for o in (0, 10, 25, 1000)] + [{"file": "b", "offset": 0, "length": 10}]
    assert [len(x) for x in warc.ranges(rows, gap=10, most=100)] == [3, 1, 1]
    assert [len(x) for x in warc.ranges(rows, gap=10, most=20)] == [2, 1, 1, 1]
