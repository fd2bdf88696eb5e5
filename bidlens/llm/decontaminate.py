"""Benchmark decontamination: short test items inside long documents.

Items are dealt into partitions by size. Each keeps a bottom-k MinHash sketch, its k least shingle hashes, with k
fixed for the partition so that a document holding a `containment` share of the item must hold one of them: k is the
partition's largest size, less what must be shared, and one. So the search loses nothing, whatever the document's
length. Candidates are verified by exact shingle containment, on the words themselves.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. An item's shingles are five words, or all its words where it has fewer; a
document is looked through for runs of each length that the items have, so that an item of two words is found inside a long
document. Items without words are in no document, and null and empty texts hold none. The items are a query set: they are
broadcast in blocks of at most BLOCK_BYTES of text, and every block meets all documents. Each row of either table stands for
itself. An empty table of either kind finds nothing; columns that are not asked for are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import rolling, shingles, slices, texts, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 16 << 20
_TABLE_BITS = 20


def _exact(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class Sketches:
    """The sketches of items whose shingles have one length, as sorted hashes with their owners."""

    def __init__(self, hashes: list[np.ndarray], owners: list[int]):
        h, o = np.concatenate(hashes), np.array(owners, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def near(self, own: np.ndarray) -> set[int]:
        """The items of which some of these hashes are in the sketch."""
        own = np.unique(own[self.table[own >> np.uint64(64 - _TABLE_BITS)]])
        lo, hi = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, "right")
        return {int(x) for a, b in zip(lo[hi > lo], hi[hi > lo]) for x in self.owners[a:b]}


class Items:
    """A block of items, their sketches by length of shingle and size partition."""

    def __init__(self, rows: list[tuple[int, str]], k: int, containment: float):
        self.containment = containment
        self.items: list[tuple[int, int, set[bytes]]] = []
        hashes: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[int]] = {}
        for item, text in rows:
            words = text.encode().lower().split()
            own = shingles(words, k)
            if len(own):
                n = min(k, len(words))
                largest = (1 << len(own).bit_length()) - 1  # of the partition
                sketch = own[: largest - math.ceil(containment * largest - 1e-9) + 1]
                hashes.setdefault(n, []).append(sketch)
                owners.setdefault(n, []).extend([len(self.items)] * len(sketch))
                self.items.append((item, n, _exact(words, n)))
        self.sketches = {n: Sketches(h, owners[n]) for n, h in hashes.items()}

    def found(self, words: list[bytes]) -> list[tuple[int, float, int]]:
        """Item, containment and the item's shingles, of the items that a document holds."""
        h = word_hashes(words)
        out = []
        for n, sketches in self.sketches.items():
            near = sketches.near(rolling(h, n))
            exact = _exact(words, n) if near else set()
            for i in sorted(near):
                item, _, want = self.items[i]
                share = len(want & exact)
                if share >= self.containment * len(want) - 1e-9:
                    out.append((item, share / len(want), len(want)))
        return out


def item_blocks(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The items in broadcast blocks, each collected by itself."""
    slim = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    total = slim.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, math.ceil(1.25 * total / block_bytes))
    for b in range(blocks):
        own = slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield items.sparkSession.sparkContext.broadcast(Items([(r.item, r.text) for r in own], k, containment))


def contaminations(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id_col, item_id, containment and n_item_shingles of every document and item of at least that containment."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))

    def search(block: Broadcast) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(doc, *x) for doc, t in zip(part.column("doc").to_pylist(), texts(part)) for x in block.value.found(t.lower().split())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc", "item_id", "containment", "n_item_shingles"])

        return slim.mapInArrow(found, "doc long, item_id long, containment double, n_item_shingles long")

    out = None
    for block in item_blocks(items, **how):
        out = search(block) if out is None else out.unionByName(search(block))
    return out.withColumnRenamed("doc", id_col)


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no item."""
    for block in item_blocks(items, **how):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    yield part.filter(pa.array([not block.value.found(t.lower().split()) for t in texts(part, text_col)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
