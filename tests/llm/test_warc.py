import base64
import hashlib

import pytest

from ledgerloom.llm import warc


def test_round_trip_of_records(spark, tmp_path):
    big = "é" * 300_000
    pages = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, "http://c\r\nX: y", "same"), (1, "http://d/", None), (2, None, ""), (4, "http://e/", big), (3, "http://b/", "same"),
             (None, "http://f/", "same"), (None, "http://g/", "alone\r\n\r\nWARC-Type: revisit\r\n"), (7, "http://h/", "tiny"), (8, "http://h/", "tiny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS row")
    warc.write_archive(df, str(tmp_path / "a"), least=0)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 5
    rows = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(rows) == len(pages) == len({r.record_id for r in rows})
    seen = []
    for r in rows:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head + b"\r\n\r\n" == bytes(r.header) and body.endswith(b"\r\n\r\n")
        body = body[:-4]
        assert len(body) == int(fields["Content-Length"])
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert fields["WARC-Payload-Digest"] == "sha1:" + digest
        assert body == (b"" if fields["WARC-Type"] == "revisit" else bytes(r.payload))
        page = fields["WARC-Record-ID"].split(":")[2]
        seen.append((int(page) if page else None, bytes(r.payload).decode(), fields["WARC-Type"], fields.get("WARC-Refers-To", "::").split(":")[2], fields.get("WARC-Target-URI")))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((p, h or "") for p, _, h in pages), key=key) == sorted(((s[0], s[1]) for s in seen), key=key)
    assert sum(s[2] == "response" for s in seen) == 5
    assert {s[3] for s in seen if s[1] == "same" and s[2] == "revisit"} == {"3"}
    assert [s[4] for s in seen if s[0] == 9] == ["http://c%0D%0AX: y"] and [s[4] for s in seen if s[0] == 2] == [None]


def test_small_payloads_are_all_responses_and_faults_are_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"), least=4)
    types = sorted((r.record_id, b"WARC-Type: response" in bytes(r.header)) for r in warc.read_archive(spark, str(tmp_path / "a")).collect())
    assert [t for _, t in types] == [True, True, True, False]
    spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "CAST('x' AS BINARY) AS payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not give its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
