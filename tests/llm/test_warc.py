import gzip
import hashlib

import pytest

from tidemark.llm import warc as W

LONG = "x" * 200 + "\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\né"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        r = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if r else "response", f if r else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(5, "http://a", LONG), (3, "http://b", LONG), (9, None, LONG), (3, "http://b", LONG), (1, "u\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", LONG), (7, "u", "y" * 300000), (8, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in W.round_trip(df).collect()), key=str)
    assert got == expected(rows)


def test_nested_rows_and_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}</p>" * 30) for i in range(9)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = W.assemble(W.read_archives(spark, str(tmp_path / "w"), with_payload=True)).collect()
    assert len(got) == 9 and all(r.request and r.metadata for r in got)
    payloads = sorted(r.response.payload.decode() for r in got if r.response.type == "response")
    assert payloads == sorted(f"<p>{i}</p>" * 30 for i in range(3))


def test_gzip_members_and_bad_archives():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd\r\n\r\n"
    assert [r["payload_bytes"] for r in W.parse_archive(gzip.compress(one) + gzip.compress(one))] == [4, 4]
    assert list(W.parse_archive(b"")) == []
    with pytest.raises(ValueError):
        list(W.parse_archive(one[:-10]))
    with pytest.raises(ValueError):
        list(W.parse_archive(b"nonsense\r\n\r\n"))


def test_assembly_without_partners(spark):
    schema = W.RECORD
    rec = lambda t, i, c: (t, i, c, None, "sha256:00", 1, "00", None, None)
    df = spark.createDataFrame([rec("response", "a", None), rec("request", "q2", "a"), rec("request", "q1", "a"), rec("request", "q3", "zz"), rec("metadata", "m", None)], schema)
    (r,) = W.assemble(df).collect()
    assert r.request.id == "q1" and r.metadata is None
    assert W.assemble(df.limit(0)).count() == 0 and W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
