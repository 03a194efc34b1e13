import base64
import hashlib
import io

import pytest

from tillgrain.llm import warc
from tillgrain.llm.queries import op4

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for k, _, h in rows:
        if k is not None:
            best[h or ""] = max(best.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        top = best.get(h or "")
        own = top is None or k == top
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.k, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_by_brute_force(spark):
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/ c", "<p>x"), (3, None, None), (4, "u", ""), (5, "é", "漢🙂\r\n\r\nWARC/1.0\r\n"), (None, "n", "<p>x"), (None, "n", "only"), (7, "r", "same"), (7, "r", "same"), (8, "l", "long" * 100_000)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS path", "'y' AS number", "'z' AS k")
    assert rows_of(warc.archive(pages)) == brute(rows)
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_bytes(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")]
    got = {r.k: r.record_type for r in warc.archive(spark.createDataFrame(rows, SCHEMA), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions_are_read_by_their_declared_fields(version):
    documents = [b"", b"one\ntwo\n\n", b"\x00\xff" * 50]
    file = warc.arc_head(version, "f.arc") + b"".join(warc.arc_record(version, f"http://x/{i}", "text/html", d, "f.arc", 0, date=f"2001020304050{i}") for i, d in enumerate(documents))
    got = list(warc.read_arc(io.BytesIO(file)))
    assert [r["document"] for r in got] == documents and [r["URL"] for r in got] == [f"http://x/{i}" for i in range(3)]
    assert set(got[0]) - {"document"} == set(warc.ARC_FIELDS[version].split())
    assert warc.warc_date(got[1]["Archive-date"]) == "2001-02-03T04:05:01Z"


def test_broken_files_are_errors():
    head = warc.arc_head(1, "f")
    for bad in (b"", b"http://x 1 2 3 4\n", head.replace(b"1 0 ", b"9 0 "), head + b"http://x 0.0.0.0 2001 t/h 10\nshort", head + b"a b\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(bad)))


def test_converted_record():
    record = {"URL": "http://x/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "document": warc.http_message(5, b"body")}
    fields, block = next(warc.read_warc(io.BytesIO(warc.convert(record))))
    assert fields["warc-type"] == "response" and block == record["document"]
    assert fields["warc-payload-digest"] == f"sha1:{warc.base32_sha1(b'body')}" and fields["warc-block-digest"] == f"sha1:{warc.base32_sha1(block)}"
    revisit, head = next(warc.read_warc(io.BytesIO(warc.convert(record, (9, "http://y/", "20000101000000")))))
    assert revisit["warc-type"] == "revisit" and head.endswith(b"\r\n\r\n") and revisit["warc-refers-to-target-uri"] == "http://y/"
    assert fields["warc-record-id"] == revisit["warc-record-id"]


def test_query(spark, folder):
    got = op4.query(spark, folder)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got.count() == spark.read.parquet(f"{folder}/pages.parquet").count()
