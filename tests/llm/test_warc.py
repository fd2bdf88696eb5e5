import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bidlens.llm.queries import ORACLE_SQL, QUERIES
from bidlens.llm.warc import base32_sha1, dechunked, read_records, read_warc, reassembled, write_warc

from .oracle import compare


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pages_oracle(spark, sf):
    assert compare(spark, "op1_warc", QUERIES["op1_warc"], ORACLE_SQL["op1_warc"], sf) >= 50


def test_round_trip(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    payloads = ["", None, "a", trap, trap, "\r\n", "\r\n\r\n", "é𝄞" * 3000, "\n" * 5000, "line\r\n" * 900, "0\r\n\r\n", "z" * 8192, "z" * 200_000, "end\r"]
    rows = [(i, "http://x/ y\r\nz" if i % 2 else None, p) for i, p in enumerate(payloads)] + [(3, "u", trap), (50, "u", "own"), (50, "u", "own"), (None, "u", "nil")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("block", F.lit("b")).repartition(3)
    first = defaultdict(lambda: 1 << 60)
    for i, _, p in rows:
        if i is not None:
            first[p or ""] = min(first[p or ""], i)
    for how in ({}, {"segment_bytes": 700, "chunk_bytes": 64}):
        path = str(tmp_path / f"w{len(how)}")
        write_warc(df, path, **how)
        got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.status, r.payload) for r in read_warc(spark, path).collect()), key=repr)
        want = []
        for i, _, p in rows:
            data = (p or "").encode()
            again = i is not None and first[p or ""] != i
            want.append((i, "revisit" if again else "response", first[p or ""] if again else None, len(data), digest(data), "ok", None if again else data))
        assert got == sorted(want, key=repr)
        assert {r.type for r in read_records(spark, path).collect()} == {"response", "revisit", "continuation"}
    write_warc(df.limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *more, b"Content-Length: %d" % len(block)]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    seg = lambda n, *x: (b"WARC-Segment-Number: %d" % n, *x)
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    a = http + b"5\r\nhello\r\n0\r\n\r\n"
    files = {
        "one": record(b"response", b"<a>", a[:30], *seg(1)) + record(b"continuation", b"<c2>", b"xx", *seg(2, b"WARC-Segment-Origin-ID: <b>", b"WARC-Segment-Total-Length: 9"))[:-6] + b"",
        "two": record(b"continuation", b"<a3>", a[40:], *seg(3, b"WARC-Segment-Origin-ID: <a>", b"WARC-Segment-Total-Length: %d" % len(a))) + record(b"response", b"<d>", http + b"5\r\nhel"),
        "three": record(b"continuation", b"<a2>", a[30:40], *seg(2, b"WARC-Segment-Origin-ID: <a>")) * 2 + record(b"response", b"<e>", a, *seg(1)) + record(b"warcinfo", b"<f>", b"software: x"),
        "four": record(b"response", b"<g>", a[:9], *seg(1)) + record(b"continuation", b"<g2>", a[9:], *seg(2, b"WARC-Segment-Origin-ID: <g>", b"WARC-Segment-Total-Length: 999")),
    }
    for name, data in files.items():
        with gzip.open(tmp_path / f"{name}.warc.gz", "wb") as f:
            f.write(data)
    got = {r.record_id: r.status for r in reassembled(read_records(spark, str(tmp_path))).collect()}
    assert got == {"<a>": "ok", "<d>": "ok", "<e>": "missing_segment", "<f>": "ok", "<g>": "length_mismatch"}
    got = {r.digest: r for r in read_warc(spark, str(tmp_path)).collect()}
    rows = {r.payload: r.status for r in read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()}
    assert rows[b"hello"] == "ok" and "bad_chunk" in {r.status for r in read_warc(spark, str(tmp_path)).collect()}


def test_small_parts(spark):
    assert dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc" and dechunked(b"3\r\nab") is None and dechunked(b"zz\r\n") is None and dechunked(b"") is None
    got = spark.createDataFrame([(b"",), (b"\xff\x00",)], "b binary").select("b", base32_sha1(F.col("b")).alias("d")).collect()
    assert all(r.d == digest(bytes(r.b)) for r in got)


def test_plain_files_raise(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\n\r\n")
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path))
