import gzip
import hashlib

from pyspark.sql import functions as F

from graphloom.llm import warc as W
from graphloom.llm._common import new_path


def rebuilt(spark, rows, file_bytes=W.FILE_BYTES):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    pages = pages.withColumns({c: F.lit("own") for c in ("size", "first", "uid", "capture", "value", "record_id")})  # clashing names
    path = W.write_archives(pages, new_path(spark, "warc-test"), file_bytes)
    narrow = W.read_records(spark, path, payloads_of=["request", "metadata"])
    return W.assemble(narrow, W.read_records(spark, path, kinds=["response", "revisit"]))


def test_round_trip_with_revisits(spark):
    big = "é" * 60
    nasty = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz" * 4
    rows = [(1, "http://a/", "small"), (2, "http://b/", "small"), (5, "http://c/\r\nX: y", big), (3, None, big), (4, "http://e/", nasty), (6, "f", None), (7, "g", "z" * 500_000), (8, "h", nasty), (None, "i", big), (9, "j", "k\x00l")]
    got = {}
    for r in rebuilt(spark, rows).collect():
        c = r["capture"]
        page = bytes(r["metadata"][0]["payload"]).decode().split("page-id: ")[1].strip()
        assert r["requests"][0]["type"] == "request" and r["requests"][0]["concurrent_to"] == [r["capture_id"]]
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        got[int(page) if page else None] = (c["type"], c["payload_bytes"], c["payload_digest"], c["refers_to"], bytes(c["payload"]))
    texts = {i: (t or "").encode() for i, _, t in rows}
    assert set(got) == set(texts)
    for i, data in texts.items():
        first = {5: "3", 8: "4"}.get(i)
        kind = "revisit" if first else "response"
        assert got[i] == (kind, len(data), hashlib.sha256(data).hexdigest(), first, b"" if first else data), i


def test_repeated_rows_and_empty(spark):
    row = (3, "u", "w" * 200)
    out = rebuilt(spark, [row, row, (9, "v", "w" * 200)]).collect()
    assert sorted(r["capture"]["type"] for r in out) == ["response", "response", "revisit"]
    assert rebuilt(spark, []).count() == 0


def test_foreign_records_link_either_way(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <{}>\r\n{}Content-Type: application/http\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\n\r\nhello"
    data = head.format("response", "r1", "WARC-Concurrent-To: <q1>\r\n", len(http), http) + head.format("request", "q1", "", 14, "GET / HTTP/1.1") + head.format("request", "lost", "", 14, "GET / HTTP/1.1")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(gzip.compress(data[:100].encode()) + gzip.compress(data[100:].encode()))
    (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in (data.replace("r1", "r2").replace("q1", "q2"))))
    (tmp_path / "plain.warc").write_text(data, newline="")
    names = lambda df: sorted(r["record_id"] for r in df.collect())
    rows = W.read_records(spark, f"file://{folder}")
    assert names(rows) == ["<lost>", "<lost>", "<q1>", "<q2>", "<r1>", "<r2>"]
    assert names(W.read_records(spark, f"file://{tmp_path}/plain.warc", compressed=False)) == ["<lost>", "<q1>", "<r1>"]
    out = {r["capture_id"]: r for r in W.assemble(rows).collect()}
    assert [x["record_id"] for x in out["<r1>"]["requests"]] == ["<q1>"] and [x["record_id"] for x in out["<r2>"]["requests"]] == ["<q2>"]
    assert out["<lost>"]["capture"] is None and bytes(out["<r1>"]["capture"]["payload"]) == b"hello"


def test_many_small_files(spark):
    rows = [(k, f"u{k}", f"{k} " * 500) for k in range(200)]
    got = rebuilt(spark, rows, file_bytes=20_000).collect()
    assert sorted((bytes(r["metadata"][0]["payload"]).decode(), bytes(r["capture"]["payload"]).decode()) for r in got) == sorted((f"page-id: {k}\r\n", t) for k, _, t in rows)
