"""Best-fit packing of documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the sequence length, so the instance is its histogram: at most `size` counts,
whatever the corpus. On it the Martello-Toth reduction fixes sets of at most three pieces that dominate every
other set holding their largest piece; best-fit decreasing packs the rest, all bins alike at once. The plan is
a bounded table of runs (length, first rank, count, first sequence, pieces a sequence, offset). Pieces take
their ranks among those of equal length by a distributed numbering and look their places up in it.

Null texts are empty ones: a document of the end id alone. Every row is a document; repeated rows are packed
each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .scratch import stored
from .tokens import Encoder
from .words import slices

SIZE = 1024
END_ID = 2
#: Rows of a plan at most: each length meets each group of like bins once at most.
_PLAN = "p_length int, p_rank long, p_count long, p_sequence long, p_each int, p_offset int"


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """doc id, piece, start, length, ids_crc32 and (with keep_ids) ids, binary of little-endian uint32.

    A document is its ids and end_id. Only documents longer than `size` are cut, into pieces of `size`; the
    remainder is the first piece. `tokenizer` is a tokenizers file; `ranks` see Encoder.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    types = [("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if keep_ids else [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, ranks)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    ids = encoder.ids(text or "") + end
                    n = len(ids) // 4
                    edges = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own)[: len(types)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    out = slim.mapInArrow(cut, "doc long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("doc", id_col)


class Plan:
    """Places for pieces of given lengths and counts, in sequences of `size`."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.rows, self.sequences = size, [], 0
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.ranks: dict[int, int] = defaultdict(int)
        self.fixed = self.reduce()
        self.best_fit()

    def _put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.ranks[length], count, sequence, each, offset))
        self.ranks[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int]) -> None:
        """Fill as many sequences with these pieces as there are."""
        need = {n: lengths.count(n) for n in dict.fromkeys(lengths)}
        times = min(self.left[n] // k for n, k in need.items())
        offset = 0
        for n, k in need.items():
            self._put(n, times * k, self.sequences, k, offset)
            offset += n * k
        self.sequences += times

    def _dominating(self, j: int) -> list[int] | None:
        """A set with j that dominates every feasible set with j, if one of at most three pieces is found."""
        room = self.size - j
        own = sorted(self.left)
        if self.left[j] == 1:
            own.remove(j)
        fits = own[: bisect_right(own, room)]
        if not fits:
            return [j]
        most = fits[-1]
        if most == room:
            return [j, most]
        free = lambda n: self.left[n] - (n == j)
        least = [n for n in fits[:3] for _ in range(min(3, free(n)))][:3]
        if len(least) < 2 or sum(least[:2]) > room:
            return [j, most]
        if len(least) == 3 and sum(least) <= room:
            return None
        # Two more at most: pairs p >= q that fit, and the largest sum among those with q over a bound.
        def best(over: int) -> int:
            top, hi = 0, len(fits) - 1
            for lo, q in enumerate(fits):
                while hi > lo and q + fits[hi] > room:
                    hi -= 1
                if hi < lo or q + fits[hi] > room:
                    break
                p = fits[hi]
                if p == q and free(q) < 2:
                    continue
                if q > over:
                    top = max(top, p + q)
            return top

        if best(0) <= most:
            return [j, most]
        rest = [n for n in fits[: bisect_right(fits, room - most)] if free(n) > (n == most)]
        if rest and best(rest[-1]) <= most:
            return [j, most, rest[-1]]
        return None

    def reduce(self) -> int:
        """Fix dominating sets, from the largest piece down, until none is left; the number of sequences."""
        changed = True
        while changed and self.left:
            changed = False
            for j in sorted(self.left, reverse=True):
                while j in self.left and (found := self._dominating(j)):
                    self._fix(found)
                    changed = True
        return self.sequences

    def best_fit(self) -> None:
        """Best-fit decreasing: each piece goes where the least room that holds it is. Bins filled alike move together."""
        bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, number)
        for n in sorted(self.left, reverse=True):
            room = n
            while (c := self.left.get(n, 0)) and room < self.size:
                if not bins[room]:
                    room += 1
                    continue
                at, number = bins[room].pop()
                each = room // n
                full = min(number, c // each)
                if full:
                    self._put(n, full * each, at, each, self.size - room)
                    bins[room - each * n].append((at, full))
                if full < number:
                    some = self.left.get(n, 0) if c // each < number else 0
                    if some:
                        self._put(n, some, at + full, some, self.size - room)
                        bins[room - some * n].append((at + full, 1))
                        full += 1
                    if full < number:
                        bins[room].append((at + full, number - full))
            if c := self.left.get(n, 0):
                each = self.size // n
                for number, k in ((c // each, each), (1, c % each)):
                    if number and k:
                        self._put(n, number * k, self.sequences, k, 0)
                        bins[self.size - k * n].append((self.sequences, number))
                        self.sequences += number


def packed(cut: DataFrame, *, id_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` is read three times: pass a written table."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    if bad := [n for n in counts if n is None or not 1 <= n <= size]:
        raise ValueError(f"lengths outside 1 to {size}: {bad[:3]}")
    plan = spark.createDataFrame(Plan(counts, size).rows, _PLAN)
    ranked = numbered(cut, "length", [F.col(id_col), F.col("piece")], "_rank")
    rank = F.col("_rank") - F.col("p_rank")
    where = (F.col("length") == F.col("p_length")) & (rank >= 0) & (rank < F.col("p_count"))
    placed = ranked.join(F.broadcast(plan), where)
    return placed.select(*cut.columns, (F.col("p_sequence") + F.floor(rank / F.col("p_each"))).cast("long").alias("sequence_id"), (F.col("p_offset") + F.col("length") * (rank % F.col("p_each"))).cast("long").alias("offset"))


def sequences(placed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Whole sequences of pieces with ids: sequence_id, length, parts (doc, piece, offset, length) and ids, in order."""
    part = F.struct("offset", F.col(id_col).alias("doc"), "piece", "length", "ids")
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    bare = F.transform("p", lambda x: F.struct(x["doc"].alias("doc"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return ordered.select("sequence_id", (F.octet_length(joined) / 4).cast("long").alias("length"), bare.alias("parts"), joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, **how) -> DataFrame:
    """pieces() of the documents, packed."""
    return packed(stored(pieces(docs, tokenizer, ranks, **how), "pieces"), id_col=how.get("id_col", "doc_id"), size=how.get("size", SIZE))
