"""K-d tree sharding: rows go to shards of near equal bytes that are boxes in the space of their metadata.

The tree is split level by level, all nodes of a level in the same jobs: a node's widest dimension (relative to the
whole table) is cut at its weighted median. Medians are exact: each pass counts bytes over equal bins between
a node's bounds and looks again into the bin that holds the median, first along the dimension, then, among
rows equal there, by tie-break columns, until no bin that matters is left. The driver sees bins, at most
BINS a node.

Rows equal in all dimensions and tie-breaks are a group and are never split. A group that weighs as much as a shard
should is a shard of its own, whatever it weighs, and the tree deals the rest to the other shards; where a cut must leave a
group whole on one side, the sides get shards by what they weigh.

DataFrame operations only. Dimensions and tie-breaks hold no null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .scratch import stored

BINS = 1024


@dataclass
class _Node:
    shards: range
    dim: str | None = None
    cut: list = field(default_factory=list)
    share: float = 0.5
    left: _Node | None = None
    right: _Node | None = None


@dataclass
class _Search:
    """The state of a node's median: the bounds of the present column, values fixed so far, bytes before the bounds."""

    node: _Node
    columns: list[str]
    target: float
    total: float
    lo: float
    hi: float
    fixed: list = field(default_factory=list)
    before: float = 0.0


def _literal(x) -> Column:
    return F.lit(float(x))


def _inside(s: _Search) -> Column:
    cond = F.lit(True)
    for c, v in zip(s.columns, s.fixed):
        cond = cond & (F.col(c) == _literal(v))
    c = F.col(s.columns[len(s.fixed)])
    return cond & (c >= _literal(s.lo)) & (c <= _literal(s.hi))


def _goes_left(dim: str, tie: list[str], cut: list) -> Column:
    """Whether (dim, *tie) is at most the cut, which may be shorter than the columns."""
    out = None
    for c, v in reversed([*zip([dim, *tie], cut)]):
        c, v = F.col(c), _literal(v)
        out = (c <= v) if out is None else (c < v) | ((c == v) & out)
    return out


def _leaf(node: _Node, tie: list[str], found: dict[int, int]) -> Column:
    if node.left is None:
        return F.lit(found[id(node)])
    return F.when(_goes_left(node.dim, tie, node.cut), _leaf(node.left, tie, found)).otherwise(_leaf(node.right, tie, found))


def _leaves(node: _Node) -> list[_Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def kd_shards(rows: DataFrame, dims: list[str], weight: str, *, n_shards: int | None = None, target_bytes: int | None = None, tie: list[str], tolerance: float = 0.001) -> DataFrame:
    """rows with `shard`, 0 to n_shards - 1 (or as many as target_bytes asks for), in tree order.

    dims and tie are numeric columns without null or NaN; rows alike in all of them are a group. A cut is taken between
    bins as soon as the bin at the median weighs no more than `tolerance` of its node. The tree's plan grows with the
    number of shards, some thousands at most. `rows` is read once a pass: pass a written table of slim rows.
    """
    total = float(rows.agg(F.sum(weight)).first()[0] or 0)
    shards = n_shards or max(1, math.ceil(total / target_bytes))
    key = [*dims, *tie]
    groups = rows.groupBy(*key).agg(F.sum(weight).alias("_w")).where(F.col("_w") >= total / shards)
    heavy = groups.orderBy(F.desc("_w"), *key).limit(shards - 1).collect()
    alone = F.lit(None).cast("int")
    for i, g in enumerate(heavy):
        alone = F.when(reduce(and_, (F.col(c) == F.lit(g[c]) for c in key)), shards - 1 - i).otherwise(alone)
    rest = rows.where(alone.isNull()) if heavy else rows
    tree = _tree(rest, dims, weight, shards - len(heavy), tie, tolerance)
    return rows.withColumn("shard", F.coalesce(alone, tree) if heavy else tree)


def _tree(rows: DataFrame, dims: list[str], weight: str, shards: int, tie: list[str], tolerance: float) -> Column:
    """The shard of a row, as nested conditions."""
    bounds = rows.agg(F.sum(weight).alias("w"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    width = {c: (bounds[f"hi_{c}"] or 0) - (bounds[f"lo_{c}"] or 0) or 1 for c in dims}
    root = _Node(range(shards))
    while open_ := [n for n in _leaves(root) if len(n.shards) > 1]:
        number = {id(n): i for i, n in enumerate(_leaves(root))}
        at = rows.withColumn("_node", _leaf(root, tie, number))
        spread = {r["_node"]: r for r in at.groupBy("_node").agg(F.sum(weight).alias("w"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        searches = []
        for n in open_:
            r = spread.get(number[id(n)])
            half = len(n.shards) // 2
            if r is None:  # no rows: any cut will do
                n.dim, n.cut = dims[0], [float("inf")]
            else:
                n.dim = max(dims, key=lambda c: (r[f"hi_{c}"] - r[f"lo_{c}"]) / width[c])
                searches.append(_Search(n, [n.dim, *tie], float(r["w"]) * half / len(n.shards), float(r["w"]), float(r[f"lo_{n.dim}"]), float(r[f"hi_{n.dim}"])))
        while searches:
            which = bin_ = None
            value = None
            for s in searches:
                here = (F.col("_node") == number[id(s.node)]) & _inside(s)
                c = F.col(s.columns[len(s.fixed)])
                b = F.least(F.floor((c - _literal(s.lo)) * _literal(BINS / (s.hi - s.lo))), F.lit(BINS - 1)) if s.hi > s.lo else F.lit(0)
                which = F.when(here, number[id(s.node)]) if which is None else which.when(here, number[id(s.node)])
                bin_ = F.when(here, b.cast("int")) if bin_ is None else bin_.when(here, b.cast("int"))
                value = F.when(here, c.cast("double")) if value is None else value.when(here, c.cast("double"))
            counted = at.select(which.alias("n"), bin_.alias("b"), value.alias("v"), F.col(weight).alias("w")).where("n IS NOT NULL")
            bins: dict[int, list] = {}
            for r in counted.groupBy("n", "b").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                bins.setdefault(r.n, []).append((r.b, float(r.w), r.lo, r.hi))
            searches = [s for s in searches if not _advanced(s, sorted(bins[number[id(s.node)]]), tolerance)]
        for n in open_:
            half = min(max(round(len(n.shards) * n.share), 1), len(n.shards) - 1)
            n.left, n.right = _Node(n.shards[:half]), _Node(n.shards[half:])
    return _leaf(root, tie, {id(n): n.shards[0] for n in _leaves(root)})


def _advanced(s: _Search, bins: list, tolerance: float) -> bool:
    """Take one step towards the median; True when the node's cut is set."""
    before, last = s.before, None
    for b, w, lo, hi in bins:
        if before + w >= s.target or b == bins[-1][0]:
            break
        before, last = before + w, hi
    last_column = len(s.fixed) == len(s.columns) - 1
    one = lo == hi
    if w <= tolerance * s.total or (one and last_column):
        # The nearer edge of the bin; rows before it that an earlier pass has left behind are less than its least value.
        nearer = abs(before + w - s.target) <= abs(before - s.target)
        s.node.share = (before + w * nearer) / s.total if s.total else 0.5
        s.node.cut = [*s.fixed, hi if nearer else math.nextafter(lo, -math.inf) if last is None else last]
        return True
    s.before = before
    if one:
        s.fixed.append(lo)
        s.lo, s.hi = _FULL
    else:
        s.lo, s.hi = lo, hi
    return False


#: Bounds of a tie-break column before its first pass; the pass finds the true ones.
_FULL = (-(2.0**63), 2.0**63)


def sharded_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Columns id_col, size (UTF-8 bytes and 1), text_crc32, shard and slot (0, 1, ... within the shard).

    The dimensions are the document's size, its bytes a character and its lines, on log scales: what equal
    texts have equal. Ties go by text_crc32 and no further, so that equal texts are never split. Null texts have size 1.
    """
    text = F.col(text_col).cast("string")
    bare = F.coalesce(text, F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(bare) + 1).cast("long").alias("size"),
        F.crc32(bare).alias("text_crc32"),
        F.log2(F.octet_length(bare) + F.lit(1.0)).alias("d_size"),
        ((F.octet_length(bare) + F.lit(1.0)) / (F.length(bare) + F.lit(1.0))).alias("d_script"),
        F.log2(F.length(bare) - F.length(F.replace(bare, F.lit("\n"))) + F.lit(1.0)).alias("d_lines"),
    )
    slim = slim.withColumn("t_crc", F.col("text_crc32").cast("double")).withColumn("row", F.monotonically_increasing_id())
    slim = stored(slim, "shard_points")
    out = kd_shards(slim, ["d_size", "d_script", "d_lines"], "size", n_shards=n_shards, tie=["t_crc"])
    placed = numbered(out.select("id", "size", "text_crc32", "row", "shard"), "shard", [F.col("text_crc32"), F.col("id"), F.col("row")], "slot").drop("row")
    return placed.withColumnRenamed("id", id_col)
