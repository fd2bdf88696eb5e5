"""Hard negatives by a secondary sort: an anchor's scored rows stream by in descending order, and positives open windows on them.

Scores are worked out in pairs of blocks (anchors x rows), so no side is collected or broadcast. A first pass finds each
anchor's positives, the best of every pair of blocks and then the best of those; a second one lets a pair of blocks send only
what may be among the first rows of a positive's window. What is sent is packed into keys of 25 bytes (anchor, descending score,
positives before others, id) that sort as bytes. `repartition` by anchor and `sortWithinPartitions` by key are the
DataFrame's repartitionAndSortWithinPartitions; an iterator then reads each partition once, with the open windows of one anchor
as its only state. Shuffled rows are anchors x blocks x a constant, never anchors x rows.

Vectors are rounded down to whole multiples of 1/256 and scored by their inner product, exactly; scores beyond 2 ** 56 count as
2 ** 56. Shorter vectors are filled up with zeros. Rows with a null id, label or vector, or with a null or non-finite component,
take no part. Of rows that share an id, one takes part: that of the least label and then the least vector. Ties go to smaller
ids. An empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import BATCH, crossed, matrix
from .scratch import dropped, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's, at least and at most.
LOW, HIGH = 50, 95
_KEY = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
_MOST = 1 << 56
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys (int64 each) whose order as bytes is by anchor, descending score, kind and id."""
    out = np.empty(len(anchors), _KEY)
    out["anchor"] = anchors.astype(np.int64).view(np.uint64) ^ _SIGN
    out["down"] = ~(scores.astype(np.int64).view(np.uint64) ^ _SIGN)
    out["kind"] = kind
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    raw, n = out.tobytes(), _KEY.itemsize
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def unpacked(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, scores, kinds and ids of keys."""
    k = np.frombuffer(b"".join(keys), _KEY)
    signed = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return signed(k["anchor"]), signed(~k["down"]), k["kind"].astype(np.int64), signed(k["id"])


def whole_numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors in multiples of 1 / SCALE, rounded down."""
    return np.floor(SCALE * np.clip(matrix(column), -1e30, 1e30))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, int64 and at most 2 ** 56 either way."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if n * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:  # doubles add them up exactly
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(exact(a) @ exact(b).T, -_MOST, _MOST).astype(np.int64)


def _batches(q: pa.Table, x: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The scores of a block of anchors with BATCH items at a time, the items' ids in ascending order, and where labels are equal."""
    x = x.sort_by("id")
    a, q_label = whole_numbers(q["v"]), q["label"].to_numpy()
    for at in range(0, len(x), BATCH):
        part = x.slice(at, BATCH)
        yield products(a, whole_numbers(part["v"])), part["id"].to_numpy(), q_label[:, None] == part["label"].to_numpy()[None, :]


def _firsts(scores: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores in each row of those that may count, ties by column."""
    least = np.iinfo(np.int64).min
    left, rows, cols = np.where(may, scores, least), [], []
    every = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        best = left.argmax(axis=1)
        there = np.flatnonzero(left[every, best] > least)
        if not len(there):
            break
        rows.append(there)
        cols.append(best[there])
        left[there, best[there]] = least
    none = [np.zeros(0, np.int64)]
    return np.concatenate(rows or none), np.concatenate(cols or none)


def _best(k: int, group: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the k highest scores of each group are, ties by id."""
    order = np.lexsort((ids, -scores, group))
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    at = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[at < k]


def _joined(found: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * n


def _keys(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> pa.Table:
    return pa.table({"anchor": pa.array(anchors, pa.int64()), "key": pa.array(packed(anchors, scores, kind, ids), pa.binary())})


def _positive(k: int):
    def work(q: pa.Table, x: pa.Table) -> pa.Table:
        own, found = q["id"].to_numpy(), []
        for scores, ids, same in _batches(q, x):
            r, c = _firsts(scores, same & (own[:, None] != ids[None, :]), k)
            found.append((own[r], scores[r, c], ids[c]))
        anchors, scores, ids = _joined(found, 3)
        keep = _best(k, anchors, scores, ids)
        return _keys(anchors[keep], scores[keep], 0, ids[keep])

    return work


def _negative(k: int, low: int, high: int):
    def work(q: pa.Table, x: pa.Table) -> pa.Table:
        own, found = q["id"].to_numpy(), []
        opened = [unpacked(keys)[1] for keys in q["positives"].to_pylist()]
        windows = max(map(len, opened), default=0)
        with_window = [np.flatnonzero([len(o) > n for o in opened]) for n in range(windows)]
        for scores, ids, same in _batches(q, x):
            for n, there in enumerate(with_window):
                p, s = np.array([opened[i][n] for i in there])[:, None], scores[there]
                r, c = _firsts(s, ~same[there] & (low * p <= 100 * s) & (100 * s <= high * p), k)
                found.append((there[r] * windows + n, s[r, c], ids[c]))
        group, scores, ids = _joined(found, 3)
        keep = _best(k, group, scores, ids)
        once = np.unique(np.column_stack([group[keep] // max(windows, 1), scores[keep], ids[keep]]), axis=0)
        return _keys(own[once[:, 0]], once[:, 1], 1, once[:, 2])

    return work


def _windows(k_positive: int, k_negative: int, low: int, high: int):
    """Reads rows sorted by key: a positive opens a window, a negative goes to those it fits, a full or passed window closes."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, n_opened = None, [], 0
        for batch in batches:
            out = []
            for anchor, score, kind, i in zip(*(c.tolist() for c in unpacked(batch.column("key").to_pylist()))):
                if anchor != now:
                    now, opened, n_opened = anchor, [], 0
                if kind == 0:
                    if n_opened < k_positive:
                        n_opened += 1
                        opened.append([i, score, 0])
                    continue
                for w in opened:
                    if w[2] < k_negative and low * w[1] <= 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], i, w[1], score))
                opened = [w for w in opened if w[2] < k_negative and low * w[1] <= 100 * score]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return streamed


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and v of the rows that take part, one for each id."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    return x.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def hard_negatives(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **blocks: int,
) -> DataFrame:
    """SCHEMA: for each anchor and each of its first positives, the first negatives within the positive's window.

    `anchor` says of a row's column `id` whether it is an anchor; `blocks` are the sizes that `crossed` takes."""
    items = stored(usable(rows, id_col, label_col, vector_col), "vectors")
    anchors = stored(items.where(anchor), "anchors")
    first = crossed(anchors, items, _positive(positives), "anchor long, key binary", **blocks)
    at = F.row_number().over(Window.partitionBy("anchor").orderBy("key"))
    opened = stored(first.withColumn("at", at).where(F.col("at") <= positives).drop("at"), "positives")
    held = opened.groupBy("anchor").agg(F.sort_array(F.collect_list("key")).alias("positives"))
    asking = stored(anchors.join(held, anchors["id"] == held["anchor"]).drop("anchor"), "asking")
    fitting = crossed(asking, items, _negative(negatives, low, high), "anchor long, key binary", **blocks)
    sent = stored(opened.unionByName(fitting), "keys")
    dropped(items, anchors, opened, asking)
    return sent.repartition("anchor").sortWithinPartitions("key").select("key").mapInArrow(_windows(positives, negatives, low, high), SCHEMA)
