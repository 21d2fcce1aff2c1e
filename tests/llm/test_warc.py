"""Archives: an exact round trip, and the revisit rule against a plain version."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tractum.llm import warc
from tractum.llm.queries import op7_warc


def plain(pages):
    first, out = {}, []
    for p in sorted(pages, key=lambda p: (p.page_id is None, p.page_id or 0)):
        data = (p.html or "").encode()
        origin = first.setdefault(data, p)
        out.append((p.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if origin is p else "revisit", None if origin is p else origin.page_id))
    return sorted(out, key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = op7_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == plain(spark.read.parquet(f"{folder}/pages.parquet").collect())


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/ c\r\nWARC-Type: evil", "same"), (9, None, None), (8, "x", ""), (1, "é", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (2, "u", "é🙂\x00 " * 50_000), (7, "u", "\r\n\r\n"), (6, "u", "same"), (None, "u", "same"), (11, "u", "x"), (11, "v", "x"), (12, "w", "only"),
]


@pytest.mark.parametrize("size", [32 << 20, 1])
def test_round_trip(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, row int")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    rows = op7_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == plain(df.collect())
    warc.write_captures(df, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(PAGES)
    full = warc.assemble(records).collect()
    assert all(r.n_requests == r.n_metadata == 1 and r.request.target == r.capture.target for r in full)
    kept = {bytes(r.capture.payload).decode() for r in full if r.capture.type == "response"}
    assert kept == {h or "" for _, _, h in PAGES}
    # A capture without its request, and a request without a capture.
    broken = records.where((F.col("type") != "request") | (F.col("id") == full[0].request.id)).where(F.col("id") != full[0].id)
    assert {r.n_requests for r in warc.assemble(broken).collect()} == {0}


def test_small_payloads_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "ab" if i < 3 else "abcd") for i in range(6)], "page_id long, url string, html string")
    warc.write_captures(df, str(tmp_path / "w"), least=3)
    types = [r.capture.type for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()]
    assert sorted(types) == ["response"] * 4 + ["revisit"] * 2


def test_empty_and_damaged(spark, tmp_path):
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).count() == 0
    with pytest.raises(ValueError):
        list(warc._frames(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
