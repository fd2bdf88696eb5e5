"""Words, shingles and their hashes, in numpy inside Arrow tasks.

Words are `[^\\x20\\x09-\\x0D]+`; on UTF-8 bytes that is what bytes.split() gives, and bytes.lower()
lower-cases A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hashes a Python worker keeps; the cache is emptied when full.
CACHED_WORDS = 300_000
MULT_A = np.uint64(0x9E3779B97F4A7C15)
MULT_B = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A uint64 hash of each word."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, words)), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """x with every bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, mult: np.uint64 = MULT_A) -> np.ndarray:
    """A hash of each run of k successive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= mult
        out += h[j : j + n]
    return mixed(out)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; with fewer words, the whole sequence is one; without words, none."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(k, len(words))))


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `size` bytes of the column; a longer value stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > size and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
