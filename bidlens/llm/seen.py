"""Two Bloom filters, for keys seen once and keys seen twice.

Every task notes the bits of its own keys, which it has seen once and which twice; the tasks' notes meet by
segment of the filter, where a bit that two tasks hold, or one holds twice, enters the twice-filter. Keys seen
twice anywhere have all their bits there, so nothing is missed; a key seen once passes only where other
keys' bits happen to cover its own. Only what the filter suspects is shuffled later.

The filter's size is a parameter and its bound: 2 ** log2_bits bits (32 MB by default) whatever the input.
When keys outgrow it, it suspects more and more of them, and results stay exact; raise log2_bits on a cluster
with the memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

LOG2_BITS = 28
NOTES = "segment int, once binary, twice binary"
_SEGMENT = 16


def positions(keys: np.ndarray, log2_bits: int) -> np.ndarray:
    """The two bits of each key."""
    shift = np.uint64(64 - log2_bits)
    return np.concatenate([(keys >> shift), ((keys * np.uint64(0xA24BAED4963EE407)) >> shift)]).astype(np.uint32)


def noted(batches: Iterator[np.ndarray], log2_bits: int) -> Iterator[pa.RecordBatch]:
    """NOTES rows of all the keys (uint64) of a task. Memory follows the task's input, 8 bytes a key."""
    found = [positions(keys, log2_bits) for keys in batches if len(keys)]
    if not found:
        return
    bits = np.concatenate(found)
    found.clear()
    bits.sort()
    new = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
    many = np.diff(np.r_[new, len(bits)]) > 1
    bits = bits[new]
    segment = bits >> np.uint32(_SEGMENT)
    edges = np.r_[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]), len(bits)]
    low = (bits & np.uint32(0xFFFF)).astype("<u2")
    for at in range(0, len(edges) - 1, 512):
        rows = []
        for a, b in zip(edges[at : at + 512], edges[at + 1 : at + 513]):
            part, twice = low[a:b], many[a:b]
            rows.append((int(segment[a]), part[~twice].tobytes(), part[twice].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Notes sorted by segment into (segment, bits): the bits held twice, packed."""
    now, counts = None, np.zeros(1 << _SEGMENT, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != now:
                if now is not None and (counts > 1).any():
                    yield done()
                now = segment
                counts[:] = 0
            i = np.frombuffer(once, "<u2")
            counts[i] = np.minimum(counts[i] + 1, 2)
            counts[np.frombuffer(twice, "<u2")] = 2
    if now is not None and (counts > 1).any():
        yield done()


def twice_filter(notes: DataFrame, log2_bits: int = LOG2_BITS) -> Broadcast:
    """The twice-filter of NOTES rows, broadcast: 2 ** log2_bits bits, whatever the input."""
    spark = notes.sparkSession
    merged = notes.select("segment", "once", "twice").repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, bits binary")
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    width = 1 << (_SEGMENT - 3)
    for row in merged.toLocalIterator():
        bits[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bits)


def suspected(keys: np.ndarray, bits: np.ndarray, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """Which keys (uint64) may have been seen twice."""
    at = positions(keys, log2_bits)
    hit = (bits[at >> np.uint32(3)] >> (7 - (at & np.uint32(7)))) & 1
    return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)


def keys_noted(docs: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2_bits: int = LOG2_BITS) -> DataFrame:
    """NOTES rows of the keys that `keys` finds in docs' Arrow batches."""
    return docs.mapInArrow(lambda batches: noted((k for b in batches for k in keys(b)), log2_bits), NOTES)
