"""WARC 1.1 archives written and read by Spark, with segmented records put together again.

Writing: SQL expressions frame each payload as a chunked HTTP response, cut its block into segments and write the records
as gzip files through Spark's text sink, so that any store Spark writes to will do. Equal payloads are stored once; the others
are revisit records.

Reading: the text source streams the archives' lines (between CRLFs) and a task walks over them record by record, in constant
memory but for the record at hand. gzip files are not split, so that a file's lines come in order; archives must be gzip.
Segments are grouped by the id of the record that they continue, ordered by number, checked against the total length, and
decoded: HTTP headers off, chunked framing off.

Null payloads are empty ones; a null id or URI is written as an empty field and read as null. Rows that share an id and a payload are
each written, both as responses if that id is the payload's least. An empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

SEGMENT_BYTES = 8192
CHUNK_BYTES = 2048
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary or string: its 40 hex digits five by five."""
    h = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), _BASE32HEX, _BASE32)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One string column, value: each record's bytes but for the last line feed. Payloads of `least_bytes` and more are deduplicated."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(uri_col).cast("string"), F.lit("")), "[\\r\\n\\s]", "%20").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "length": F.octet_length("payload")})
    often = rows.where(F.col("length") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    often = stored(often, "repeated_payloads").withColumnRenamed("digest", "r_digest")
    rows = rows.join(often, (rows["digest"] == often["r_digest"]) & (rows["length"] >= least_bytes), "left").drop("r_digest")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    size = F.lit(chunk_bytes)
    chunk = lambda i: F.concat(F.hex(F.least(size, F.col("length") - i)), F.lit("\r\n"), F.substring(F.col("payload"), i + 1, size).cast("string"), F.lit("\r\n"))
    chunks = F.when(F.col("length") > 0, F.transform(F.sequence(F.lit(0), F.col("length") - 1, size), chunk)).otherwise(F.expr("cast(array() as array<string>)"))
    body = F.concat(F.lit(_HTTP + "Transfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")))
    rows = rows.withColumn("block", F.when(F.col("revisit"), F.lit(_HTTP + "\r\n")).otherwise(body).cast("binary"))
    # Repeated ids are told apart by a fragment, which is the same in all segments of a row.
    rows = rows.select("id", "uri", "digest", "revisit", "first", "block", F.octet_length("block").alias("total"), F.concat(urn(F.col("id")), F.lit("#"), F.uuid()).alias("urn"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / segment_bytes)).cast("int")
    rows = rows.withColumn("count", count).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count"))))
    part = F.substring(F.col("block"), (F.col("k") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    k, first, many = F.col("k"), F.col("k") == 1, F.col("count") > 1
    nothing = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.concat(F.col("urn"), F.when(first, ">").otherwise(F.concat(F.lit("."), k.cast("string"), F.lit(">"))))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _header("WARC-Target-URI", F.col("uri")),
        F.when(first, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(nothing),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\n"), _header("WARC-Refers-To", F.concat(urn(F.col("first")), F.lit(">"))))).otherwise(nothing),
        F.when(many, _header("WARC-Segment-Number", k.cast("string"))).otherwise(nothing),
        F.when(many & ~first, _header("WARC-Segment-Origin-ID", F.concat(F.col("urn"), F.lit(">")))).otherwise(nothing),
        F.when(many & (k == F.col("count")), _header("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(nothing),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(part).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, part.cast("string"), F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, **how) -> None:
    """Write the pages' records as gzip files under path."""
    records(pages, **how).write.text(path, compression="gzip", lineSep="\n")


_FIELDS = {b"warc-type": "type", b"warc-record-id": "record_id", b"warc-target-uri": "uri", b"warc-payload-digest": "digest", b"warc-refers-to": "refers_to", b"warc-segment-number": "segment", b"warc-segment-origin-id": "origin", b"warc-segment-total-length": "total", b"content-length": "length"}
_NUMBERS = ("segment", "total", "length")
RECORD = "type string, record_id string, uri string, digest string, refers_to string, segment long, origin string, total long, length long, block binary"
_RECORD = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _walk(lines: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
    """The records in lines of (file, line). A record that its file does not hold in full is left out of step: the walk
    goes on at the next line that begins a record."""
    record: dict | None = None
    state, file = "between", None
    parts: list[bytes] = []
    size = 0
    for at, line in lines:
        if at != file:
            file, state = at, "between"
        if state == "block":
            size += len(line) + 2 * bool(parts)
            parts.append(line)
        elif state == "head":
            if line:
                name, _, value = line.partition(b":")
                if (key := _FIELDS.get(name.strip().lower())) is not None:
                    text = value.strip().decode("utf-8", "replace")
                    record[key] = (int(text) if text.isdecimal() else None) if key in _NUMBERS else text or None
                continue
            state, parts, size = ("between" if record.get("length") is None else "block"), [], 0
            continue
        elif line.startswith(b"WARC/"):
            record, state = {}, "head"
            continue
        else:
            continue
        if size >= record["length"]:
            state = "between"
            if size == record["length"]:
                yield record | {"block": b"\r\n".join(parts)}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines() -> Iterator[tuple[int, bytes]]:
        for b in batches:
            yield from zip(b.column("file").to_pylist(), b.column("line").to_pylist())

    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[x.split()[1]]) for n, x in zip(_RECORD, RECORD.split(", "))], names=_RECORD)

    for r in _walk(lines()):
        rows.append(r)
        size += len(r["block"])
        if size > 4 << 20 or len(rows) >= 4096:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the gzip archives under path, as RECORD: one row a segment. Other files raise, as Spark would split them."""
    lines = spark.read.text(path, lineSep="\r\n")
    if other := [f for f in lines.inputFiles() if not f.endswith(".gz")]:
        raise ValueError(f"not gzip archives: {other[:3]}")
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_records, RECORD)


def dechunked(body: bytes) -> bytes | None:
    """A chunked HTTP body without its framing; None where that is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records of RECORD rows: a record and its continuations become one, with status ok, missing_segment or length_mismatch.

    A segment that is there twice counts once. Records without a segment number are whole already and not shuffled.
    """
    whole = segments.where("segment IS NULL").select(*_RECORD, F.lit("ok").alias("status"))
    parts = segments.where("segment IS NOT NULL").withColumn("key", F.coalesce("origin", "record_id")).repartition("key")
    rest = [c for c in _RECORD if c not in ("segment", "block")]
    once = parts.groupBy("key", "segment").agg(F.min(F.struct("block", *rest)).alias("r"))
    one = once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("segment", "r"))).alias("s"))
    s = F.col("s")
    head = lambda c: F.get(s, F.lit(0))["r"][c]
    block = F.array_join(F.transform(s, lambda x: x["r"]["block"].cast("string")), "").cast("binary")
    one = one.withColumns({"total": F.array_max(F.transform(s, lambda x: x["r"]["total"])), "block": block, "last": F.element_at(s, -1)["segment"]})
    gap = (head("origin").isNotNull()) | (F.get(s, F.lit(0))["segment"] != 1) | (F.col("last") != F.size(s)) | F.col("total").isNull()
    status = F.when(gap, "missing_segment").when(F.octet_length("block") != F.col("total"), "length_mismatch").otherwise("ok")
    columns = {"segment": F.lit(None).cast("long"), "total": F.col("total"), "length": F.octet_length("block").cast("long"), "block": F.col("block"), "origin": F.lit(None).cast("string"), "record_id": F.col("key")}
    return whole.unionByName(one.select(*[columns.get(c, head(c)).alias(c) for c in _RECORD], status.alias("status")))


def decoded(whole: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """type, record_id, uri, digest, refers_to, status, payload_bytes, payload_digest and (with keep_payload) payload of whole records.

    Status bad_chunk: broken framing; bad_digest: the payload is not what its header says. Revisits have no payload of their own.
    """
    kept = ["type", "record_id", "uri", "digest", "refers_to"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, stated, status, block in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "status", "block"))):
                head, _, body = (block or b"").partition(b"\r\n\r\n")
                own = None
                if kind == "response" and status == "ok":
                    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
                    own = dechunked(body) if chunked else body
                    status = "bad_chunk" if own is None else status
                name = None if own is None else base64.b32encode(hashlib.sha1(own).digest()).decode()
                if name and stated and stated.removeprefix("sha1:") != name:
                    status = "bad_digest"
                rows.append((status, None if own is None else len(own), name, own))
            columns = list(zip(*rows)) or [(), (), (), ()]
            arrays = [batch.column(c) for c in kept] + [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())] + ([pa.array(columns[3], pa.binary())] if keep_payload else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "status", "payload_bytes", "payload_digest"] + ["payload"] * keep_payload)

    schema = ", ".join(f"{c} string" for c in kept) + ", status string, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload
    return whole.select(*kept, "status", "block").mapInArrow(decode, schema)


def read_warc(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """The records under path, whole and decoded, with page_id and the page a revisit refers to.

    A revisit takes length and digest from the response with the digest that it states; without one its status is unresolved.
    """
    found = stored(decoded(reassembled(read_records(spark, path)), keep_payload=keep_payload), "warc_records")
    page = lambda c: F.regexp_extract(c, "^<urn:page:([0-9-]+)", 1).try_cast("long")
    found = found.withColumns({"page_id": page(F.col("record_id")), "refers_to": F.when(F.col("type") == "revisit", page(F.col("refers_to"))), "stated": F.regexp_replace("digest", "^sha1:", "")})
    responses = found.where("type = 'response' AND status = 'ok'").groupBy("payload_digest").agg(F.first("payload_bytes").alias("r_bytes")).withColumnRenamed("payload_digest", "r_digest")
    responses = stored(responses, "warc_responses")
    revisits = found.where("type = 'revisit'").join(responses, F.col("stated") == F.col("r_digest"), "left")
    revisits = revisits.withColumns({"payload_bytes": F.col("r_bytes"), "payload_digest": F.col("r_digest"), "status": F.when(F.col("r_digest").isNull() & (F.col("status") == "ok"), "unresolved").otherwise(F.col("status"))})
    return found.where("type <> 'revisit'").drop("stated").unionByName(revisits.drop("stated", "r_bytes", "r_digest")).withColumnRenamed("type", "record_type")
