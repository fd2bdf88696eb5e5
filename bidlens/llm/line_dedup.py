"""Line dedup: lines that many documents hold go everywhere but in one of them.

Two Bloom filters (bidlens.llm.seen) tell which line keys may repeat. Only those lines are shuffled, as whole
keys: a partial count and the largest document id confirm each exactly, and the documents that lose a line
are told so.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased. Null and empty
texts are one empty line. Every row counts as a document: repeated rows raise a key's count, and rows that
share the largest id all keep the line. A null id counts, and never is the largest unless all are null.
Other columns of the input, whatever their names, pass through `deduped_lines` untouched. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seen
from .names import unused
from .scratch import stored
from .words import slices, texts

_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, if it has `least` code points."""
    if len(line) < least:
        return None
    key = line.strip(_BLANKS).lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in set(text.split(b"\n")) if (k := line_key(line, least)) is not None}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, log2_bits: int = seen.LOG2_BITS) -> DataFrame:
    """The (doc, key) pairs to drop: keys of at least `least_chars` code points in at least `least_docs`
    documents, in each document but the one of the largest id. Columns: id (of id_col's type), keys array<binary>."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, "text"):
            yield _hashes([k for t in texts(part) for k in _keys(t, least_chars)])

    bits = seen.twice_filter(seen.keys_noted(slim.select("text"), hashed, log2_bits), log2_bits)
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, keys = [], []
                for i, t in zip(part.column("id").to_pylist(), texts(part)):
                    own = list(_keys(t, least_chars))
                    ids += [i] * len(own)
                    keys += own
                if keys:
                    hit = np.flatnonzero(seen.suspected(_hashes(keys), bits.value, log2_bits))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in hit], pa.int64()), pa.array([keys[j] for j in hit], pa.binary())], schema=schema)

    found = stored(slim.withColumn("id", F.col("id").cast("long")).mapInArrow(suspects, "id long, key binary"), "line_suspects")
    often = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).drop("n")
    # As a table, so that the join's sides are plain exchanges and a line of many documents can be split.
    often = stored(often, "often_lines")
    return found.join(often, "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("key").alias("keys"))


def deduped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, log2_bits: int = seen.LOG2_BITS) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped instead of any such columns."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, least_docs=least_docs, log2_bits=log2_bits)
    drop_id, drop_keys = unused(docs.columns, "drop_id", "drop_keys")
    drops = drops.select(F.col("id").alias(drop_id), F.col("keys").alias(drop_keys))
    joined = docs.join(drops, docs[id_col].cast("long").eqNullSafe(F.col(drop_id)), "left").drop(drop_id)
    done = [pa.field("kept_text", pa.string()), pa.field("n_lines", pa.int64()), pa.field("n_dropped", pa.int64())]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                kept, lines, dropped = [], [], []
                for text, keys in zip(texts(part, text_col), part.column(drop_keys).to_pylist()):
                    own = text.split(b"\n")
                    lines.append(len(own))
                    if keys:
                        gone = set(keys)
                        own = [x for x in own if line_key(x, least_chars) not in gone]
                        text = b"\n".join(own)
                    kept.append(text)
                    dropped.append(lines[-1] - len(own))
                rest = [(n, part.column(n)) for n in part.schema.names if n != drop_keys]
                arrays = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + arrays, names=[n for n, _ in rest] + [f.name for f in done])

    schema = joined.drop(drop_keys).schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(cleaned, schema)
