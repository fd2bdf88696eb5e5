"""Hashed bag-of-words vectors, and cosine searches over them.

An embedding is a row (id, v) for each text, v its non-zero dimensions as array<struct<dim, w>> with unit length, ordered by
dim; empty where the text has no token. It is worked out within Arrow batches, without a shuffle. Other backends can be put in
the place of `Hashed` if they return such rows; `signature` tells indexes of different backends apart.

Searches deal queries and items to blocks and multiply pairs of blocks inside tasks, which keep the k best of each query; only
these are shuffled on.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..storage import stored
from .blocks import BATCH, QUERY_ROWS, crossed

#: Tokens whose hashes a Python worker keeps; the cache is emptied when full.
CACHED_TOKENS = 300_000
_TOKEN = re.compile(b"[a-z0-9]{2,}")


class Backend(Protocol):
    dimension: int

    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame: ...

    def signature(self) -> str: ...


class _Words(dict):
    """Numbers of words, of which `dims` has the first four bytes of the MD5, little-endian, and `signs` the sign by the fifth; -1 for stop words."""

    def __init__(self):
        self.dims, self.signs = array("Q"), array("d")
        self.begin()

    def begin(self) -> None:
        """Empties a cache that is full; numbers hold until then."""
        if len(self.dims) >= CACHED_TOKENS:
            self.clear()
            self.dims, self.signs = array("Q"), array("d")
        self.update(dict.fromkeys((w.encode() for w in V.EMBED_STOPWORDS), -1))

    def __missing__(self, word: bytes) -> int:
        h = hashlib.md5(word, usedforsecurity=False).digest()
        self.dims.append(int.from_bytes(h[:4], "little"))
        self.signs.append(1.0 if h[4] % 2 else -1.0)
        value = self[word] = len(self.dims) - 1
        return value


_words = _Words()


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def _vectors(texts: list[bytes | None], dimension: int) -> pa.Array:
    """Each text's v, of texts in UTF-8. What falls on one dimension is summed in ascending order."""
    _words.begin()
    found = [list(map(_words.__getitem__, _TOKEN.findall(t.lower()))) if t else [] for t in texts]  # bytes: lowered are ASCII letters alone
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
    word = np.fromiter(chain.from_iterable(found), np.int64, len(row))
    many = max(1, len(_words.dims))
    pairs = np.sort((row * many + word)[word >= 0])
    starts = _runs(pairs)
    row, word = pairs[starts] // many, pairs[starts] % many
    counts, times = np.unique(np.diff(np.r_[starts, len(pairs)]), return_inverse=True)
    damped = np.array([1 + math.log(n) for n in counts.tolist()], float)[times]
    dims, signs = np.array(_words.dims, np.uint64), np.array(_words.signs, float)
    w, key = signs[word] * damped, row * dimension + (dims[word] % np.uint64(dimension)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    starts = _runs(key)
    sizes = np.diff(np.r_[starts, len(key)])
    shared = np.flatnonzero(np.repeat(sizes > 1, sizes))
    w[shared] = w[shared][np.lexsort((w[shared], key[shared]))]
    w = np.add.reduceat(w, starts) if len(starts) else w
    row, dim = key[starts] // dimension, key[starts] % dimension
    norm = np.sqrt(np.bincount(row, w * w, len(texts)))[row]
    w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
    parts = pa.StructArray.from_arrays([pa.array(dim.astype(np.int32)), pa.array(w)], names=["dim", "w"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), parts)


class Hashed:
    """Term counts, damped as 1 + ln, on hashed dimensions with hashed signs."""

    def __init__(self, dimension: int = 1024):
        self.dimension = dimension

    def signature(self) -> str:
        return f"hashing:{self.dimension}"

    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id and v of every text; a null one is empty."""
        slim, dimension = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), self.dimension

        def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), _vectors(batch.column(1).cast(pa.binary()).to_pylist(), dimension)], names=["id", "v"])

        v = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("w", T.DoubleType())])
        return slim.mapInArrow(embedded, T.StructType([slim.schema.fields[0], T.StructField("v", T.ArrayType(v))]))


def _matrix(vectors: pa.ListArray, dimension: int) -> np.ndarray:
    """Rows of numbers, or of struct<dim, w>, as a dense matrix."""
    row, dim, w = _entries(vectors)
    out = np.zeros((len(vectors), dimension))
    out[row, dim] = w
    return out


def _entries(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of all entries, by rows."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    inner = vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), sizes)
    if pa.types.is_struct(inner.type):
        return row, inner.field("dim").to_numpy(), inner.field("w").to_numpy()
    return row, np.arange(len(inner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), inner.to_numpy(zero_copy_only=False)


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a length are not a number."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _alike(vectors: pa.ListArray) -> np.ndarray:
    """An order of rows in which those with the same rare dimension stand together."""
    row, dim, _ = _entries(vectors)
    if not len(row):
        return np.arange(len(vectors))
    order = np.lexsort((np.bincount(dim)[dim], row))
    first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])]
    rare = np.full(len(vectors), -1)
    rare[row[first]] = dim[first]
    return np.argsort(rare, kind="stable")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and columns of the k best of each row, ties by column; -inf where there are no more. Scores are used up."""
    every, found, cols = np.arange(len(scores)), np.full((len(scores), k), -np.inf), np.zeros((len(scores), k), np.int64)
    for n in range(min(k, scores.shape[1])):
        best = scores.argmax(axis=1)
        found[:, n], cols[:, n] = scores[every, best], best
        if not (found[:, n] > -np.inf).any():
            break
        scores[every, best] = -np.inf
    return found, cols


#: Entries of a block of queries, which as many of a dense block have.
QUERY_ENTRIES = 1 << 21


def nearest(queries: DataFrame, items: DataFrame, k: int = 5, *, dimension: int, digits: int = 6, least: float | None = None, others: bool = False, normed: bool = True, sharing: bool = False, written: bool = False, **blocks: int) -> DataFrame:
    """q, id, score and rank of the k items (id, v) with the highest cosine to each query (id, v), ties by id.

    Ids can be of any type that sorts, one of each. An item has the score 0 if it shares nothing with the query, -1 if the cosine is not a
    number; with `sharing`, only items that share a dimension count; with `others`, an item is not compared with the query of its own
    id. Vectors that are not `normed` are brought to unit length. A column `bonus` of items is added to their scores.
    `least` is applied to the k best. Both sides are counted and read, and stored for it unless they are `written` tables; `blocks` are
    sizes that `crossed` takes. A block holds as many queries as have QUERY_ENTRIES, so that items are sent to few blocks
    where queries are short; they are multiplied in slices of queries with dimensions in common, by these dimensions alone.
    """
    own = [c for c in ("id", "v", "bonus") if c in items.columns]
    k = k or 5

    def found(q: pa.Table, x: pa.Table) -> pa.Table:
        x = x.take(pc.sort_indices(x["id"]))
        lists = lambda t: t["v"].combine_chunks() if len(t) else pa.array([], t.schema.field("v").type)
        v = lists(x)
        q = q.take(pa.array(_alike(lists(q)))) if normed else q
        w = lists(q)
        own_place = pc.index_in(q["id"], x["id"]).combine_chunks().fill_null(-1).to_numpy() if others else None
        bonus = x["bonus"].to_numpy() if "bonus" in own else None
        top, place = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        slices = [(a, min(a + QUERY_ROWS, len(q))) for a in range(0, len(q), QUERY_ROWS)]
        for at in range(0, len(x), BATCH):
            n = _matrix(v.slice(at, BATCH), dimension)
            n = np.ascontiguousarray((n if normed else _units(n)).T)
            for a, b in slices:
                row, dim, value = _entries(w.slice(a, b - a))
                used = np.unique(dim) if normed else np.arange(dimension)
                m = np.zeros((b - a, len(used)))
                m[row, np.searchsorted(used, dim)] = value
                own_n = n[used] if len(used) < dimension else n
                scores = (m if normed else _units(m)) @ own_n
                scores = np.round(scores, digits) + 0.0
                scores[np.isnan(scores)] = -1.0
                if bonus is not None:
                    scores = np.round(scores + bonus[at : at + BATCH], digits)
                if sharing:
                    scores[((m != 0).astype(np.float32) @ (own_n != 0).astype(np.float32)) == 0] = -np.inf
                if others:
                    here = np.flatnonzero((own_place[a:b] >= at) & (own_place[a:b] < at + n.shape[1]))
                    scores[here, own_place[a + here] - at] = -np.inf
                new, c = _best(scores, k)
                new, c = np.hstack([top[a:b], new]), np.hstack([place[a:b], at + c])
                keep = np.argsort(-new, axis=1, kind="stable")[:, :k]  # earlier items come first
                top[a:b], place[a:b] = np.take_along_axis(new, keep, 1), np.take_along_axis(c, keep, 1)
        r, n = np.nonzero(top > -np.inf)
        return pa.table({"q": q["id"].take(pa.array(r)), "id": x["id"].take(pa.array(place[r, n])), "score": pa.array(top[r, n])})

    kinds = dict(queries.dtypes)["id"], dict(items.dtypes)["id"]
    if not written:
        queries, items = stored(queries.select("id", "v"), "queries"), stored(items.select(*own), "items")
    if "query_rows" not in blocks:
        n, entries = queries.agg(F.count("*"), F.sum(F.greatest(F.size("v"), F.lit(1)))).first()
        blocks["query_rows"] = max(1, int(QUERY_ENTRIES // max(1, (entries or 0) / max(1, n))))
    out = crossed(queries.select("id", "v"), items.select(*own), found, f"q {kinds[0]}, id {kinds[1]}, score double", **blocks)
    top = ranked(out, k)
    return top if least is None else top.where(F.col("score") >= least)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by id, with rank; a rank filter that Spark applies before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= (k or 5))


def relevance(best: DataFrame, n: int = 3) -> DataFrame:
    """q and the mean of its n best scores, over as many as there are."""
    return best.where(F.col("rank") <= n).groupBy("q").agg(F.round(F.avg("score"), 6).alias("relevance"), F.count("*").alias("n_evidence"))
