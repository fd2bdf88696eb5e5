"""Substring dedup over a compacted de Bruijn graph of words.

The graph's edges are the windows of k successive words. Within a document, successive windows that share their least
inner k-mer (the anchor; half a window long, so that equal windows have equal anchors at equal places) are one path,
named by its anchor and its content; its neighbours are the paths before and after it. Two Bloom filters leave the paths
whose anchor may repeat, and equal paths collapse in an aggregation that keeps the first source coordinate and counts
degrees: whether all occurrences have the same path before and the same path after.

Repeated paths compact through joins: where a path's only successor has it as its only predecessor and the first
source coordinate of the one continues that of the other, no branch lies between them; heads of such chains are found by
doubling, and a chain is one span of its source. Where one anchor leads into several paths, these are opened and a join
finds for each window the first of all its source coordinates. The documents then verify their own spans at those
coordinates: a window goes unless its own place is the first.

Paths and windows are compared by 64-bit hashes within a 64-bit anchor, 128 bits together; words themselves are not sent.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null, empty and short texts have no window and stay. Places are
ordered by document id, then by text hash, then by word: rows that share an id but not the text count as
documents in that order; rows alike in both count as one document and share its result. A null id sorts first. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seen
from .scratch import dropped, stored
from .words import MULT_A, MULT_B, mixed, slices, texts, word_hashes

WINDOW = 20
_PLACE_BITS = np.uint64(28)


def _power(mult: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(mult), n, 1 << 64))


def _rolled(h: np.ndarray, k: int, mult: np.uint64) -> np.ndarray:
    """The polynomial of each run of k entries, by doubling; not mixed."""
    out, size = h, 1
    for bit in bin(k)[3:]:
        n = len(out) - size
        out = out[:n] * _power(mult, size) + out[size:]
        size *= 2
        if bit == "1":
            n = len(h) - size
            out = out[:n] * mult + h[size:]
            size += 1
    return out


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w entries, by doubling."""
    out, size = v, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - size : w - size + len(v) - w + 1]) if size < w else out


class Paths:
    """The paths of some documents: for each its document, first window, number of windows, anchor and name, its key, made
    of both, and the keys of its neighbours (0 at a text's ends)."""

    def __init__(self, words: list[list[bytes]], k: int):
        counts = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.r_[0, np.cumsum(counts)]
        h = word_hashes([w for ws in words for w in ws])
        anchor_words = max(1, k // 2)
        m = len(h) - k + 1
        if m <= 0:
            self.windows = self.anchor = self.name = np.zeros(0, np.uint64)
            self.at = self.doc = self.lo = self.n = self.key = self.before = self.after = np.zeros(0, np.int64)
            return
        owner = np.repeat(np.arange(len(words)), counts)
        a = mixed(_rolled(h, anchor_words, MULT_A))
        keyed = (a >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(a), dtype=np.uint64)
        place = (_least(keyed, k - anchor_words + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        own = np.flatnonzero(owner[:m] == owner[k - 1 :])
        place = place[own]
        new = np.ones(len(own), bool)
        new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)
        first = np.flatnonzero(new)
        self.windows = mixed(_rolled(h, k, MULT_B))[own]
        self.at = first  # among the windows
        self.n = np.diff(np.r_[first, len(own)])
        self.anchor = a[place[first]]
        self.name = mixed(self.windows[first] * MULT_A + self.windows[first + self.n - 1] * MULT_B + self.n.astype(np.uint64))
        self.doc = owner[own[first]]
        self.lo = own[first] - self.starts[self.doc]
        key = mixed(self.anchor * MULT_B + self.name).view(np.int64)
        same = self.doc[1:] == self.doc[:-1]
        self.key, self.before, self.after = key, np.r_[0, np.where(same, key[:-1], 0)], np.r_[np.where(same, key[1:], 0), 0]


def _parts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], Paths]]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = [t.split() for t in texts(part)]
            yield part, words, Paths(words, k)


def chains(repeated: DataFrame) -> DataFrame:
    """id, th, lo and n (windows) of the spans into which repeated paths (key, before, after, id, th, lo, n) compact.

    before and after are the only neighbours, null where there are several. Heads are found by doubling: a number of joins
    that grows with the logarithm of the longest chain."""
    left = repeated.where("after IS NOT NULL").select(F.col("key").alias("head"), F.col("after").alias("key"), F.col("id").alias("l_id"), F.col("th").alias("l_th"), (F.col("lo") + F.col("n")).alias("l_end"))
    follows = (F.col("before") == F.col("head")) & F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th")) & (F.col("lo") == F.col("l_end"))
    heads = stored(repeated.join(left, "key").where(follows).select("key", "head"), "path_heads")
    while True:
        further = heads.select(F.col("key").alias("head"), F.col("head").alias("further"))
        new = stored(heads.join(further, "head", "left").select("key", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")), "path_heads")
        dropped(heads)
        heads = new.drop("moved")
        if new.where("moved").isEmpty():
            break
        heads = stored(heads, "path_heads")
        dropped(new)
    of = repeated.join(heads, "key", "left").groupBy(F.coalesce("head", "key").alias("head"))
    return of.agg(F.min(F.struct("id", "th", "lo")).alias("p"), F.sum("n").cast("int").alias("n")).select("p.id", "p.th", "p.lo", "n")


def first_places(docs: DataFrame, bits, k: int, log2_bits: int) -> DataFrame:
    """From (id, th, text): for each document the spans of paths that start first there, and the windows of these that
    nevertheless start earlier elsewhere. Columns id, th, firsts array<struct<lo int, n int, dup int>>: n windows from lo, or
    with n of 0 the window `dup` of the path at lo."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, p in _parts(batches, k):
            hit = np.flatnonzero(seen.suspected(p.anchor, bits.value, log2_bits)) if len(p.anchor) else np.zeros(0, int)
            if not len(hit):
                continue
            rows = pa.array(p.doc[hit])
            n = p.n[hit]
            ends = np.cumsum(n)
            inner = np.repeat(p.at[hit] - (ends - n), n) + np.arange(ends[-1])
            windows = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(p.windows[inner].view(np.int64)))
            numbers = [pa.array(x[hit]) for x in (p.anchor.view(np.int64), p.name.view(np.int64), p.key, p.before, p.after)]
            yield pa.RecordBatch.from_arrays([*numbers, part.column("id").take(rows), part.column("th").take(rows), pa.array(p.lo[hit].astype(np.int32)), windows], names=["anchor", "name", "key", "before", "after", "id", "th", "lo", "windows"])

    found = docs.mapInArrow(suspects, "anchor long, name long, key long, before long, after long, id long, th long, lo int, windows array<long>")
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    first = F.min(F.struct("id", "th", "lo", "windows")).alias("p")
    paths = stored(found.groupBy("anchor", "name", "key").agg(first, F.count("*").alias("times"), one("before"), one("after")).select("anchor", "name", "key", "times", "before", "after", "p.*"), "paths")
    whole = paths.withColumn("n", F.size("windows"))
    spans = whole.where("times = 1").select("id", "th", "lo", "n").unionByName(chains(whole.where("times > 1").select("key", "before", "after", "id", "th", "lo", "n")))
    branching = paths.groupBy("anchor").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("anchor")
    opened = paths.join(branching, "anchor", "left_semi").select("anchor", "id", "th", "lo", F.posexplode("windows").alias("i", "window"))
    place = F.struct("id", "th", (F.col("lo") + F.col("i")).alias("at"))
    earliest = opened.groupBy("anchor", "window").agg(F.min(place).alias("first"))
    later = opened.join(earliest, ["anchor", "window"]).where(place != F.col("first")).select("id", "th", "lo", F.lit(0).alias("n"), F.col("i").alias("dup"))
    return spans.withColumn("dup", F.lit(0)).unionByName(later).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n", "dup")).alias("firsts"))


def deduped_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, log2_bits: int = seen.LOG2_BITS) -> DataFrame:
    """Columns id_col, n_words, n_removed, kept_text (kept words joined by one space) and
    spans array<struct<start int, n int>> (the removed runs of words)."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    notes = slim.mapInArrow(lambda batches: seen.noted((p.anchor for _, _, p in _parts(batches, k)), log2_bits), seen.NOTES)
    bits = seen.twice_filter(notes, log2_bits)
    firsts = first_places(slim, bits, k, log2_bits).select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "firsts")
    joined = slim.join(firsts, slim["id"].eqNullSafe(F.col("f_id")) & (slim["th"] == F.col("f_th")), "left").select("id", "text", "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("n", pa.int32())])
        for part, words, p in _parts(batches, k):
            column = part.column("firsts")
            owner = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            inner = column.flatten()
            lo, n, dup = (inner.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "n", "dup"))
            gone = np.zeros(len(p.windows), bool)
            if len(p.anchor):
                # All windows of suspected paths, but those of paths that start first here only where told.
                mine = np.zeros(p.starts[-1] + 1, np.int64)
                np.add.at(mine, p.starts[owner] + lo, np.sign(n))
                np.add.at(mine, p.starts[owner] + lo + n, -np.sign(n))
                first_here = np.cumsum(mine)[p.starts[p.doc] + p.lo] > 0
                gone[:] = np.repeat(seen.suspected(p.anchor, bits.value, log2_bits) & ~first_here, p.n)
                told = np.flatnonzero(n == 0)
                key = (p.doc << 32) | p.lo
                gone[p.at[np.searchsorted(key, (owner[told] << 32) | lo[told])] + dup[told]] = True
            delta = np.zeros(p.starts[-1] + 1, np.int64)
            if gone.any():
                base = np.repeat(p.starts[p.doc] + p.lo - p.at, p.n) + np.arange(len(gone))
                at = base[gone]
                np.add.at(delta, at, 1)
                np.add.at(delta, at + k, -1)
            covered = np.cumsum(delta)[:-1] > 0
            kept, removed, spans = [], [], []
            for i, ws in enumerate(words):
                c = covered[p.starts[i] : p.starts[i + 1]]
                n = int(c.sum())
                removed.append(n)
                if n:
                    kept.append(b" ".join([w for w, x in zip(ws, c.tolist()) if not x]))
                    edge = np.flatnonzero(np.diff(np.r_[0, c.astype(np.int8), 0]))
                    spans.append([{"start": int(a), "n": int(b - a)} for a, b in edge.reshape(-1, 2)])
                else:
                    kept.append(b" ".join(ws))
                    spans.append([])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))], names=["id", "n_words", "n_removed", "kept_text", "spans"])

    done = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,n:int>>")
    return done.withColumnRenamed("id", id_col)
