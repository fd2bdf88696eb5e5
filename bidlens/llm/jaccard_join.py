"""Exact Jaccard self-join of documents by word shingles, over a token-group matrix.

1. Prefix filter: of two sets that are similar enough, the first l common tokens in any fixed order lie among the first
   n - needed + l tokens of each, so that they share l tokens of these prefixes; l is a share of n. The order puts tokens
   that tasks see often last, then goes by hash. Two Bloom filters tell which prefix tokens another document may hold;
   documents with fewer than l of these are linked with nothing, and no whole set of theirs is shuffled.
2. Similar documents are partitioned into groups: they are dealt by the first suspected token of their prefixes, a hot
   one into several buckets of about GROUP documents; texts with equal sets are one document from here on; and the
   documents of a bucket that exact links connect make a group.
3. The matrix stores each group's token union, over the whole sets of its members, and which members hold which token.
4. Groups whose prefixes share enough tokens meet. Every member of one is a query on the other: its overlap with the
   union bounds its overlap with each member, and only if that leaves a link possible the group is opened to it. Opened
   groups are compared exactly, two rows of the matrix at a time: one link joins two groups.
5. Each token first offers its smallest group as a hub; then all groups of different components that share a token
   meet: those of a common token by blocks of groups, inside tasks, where bit matrices are multiplied, first of prefixes, then
   of whole unions, so that pairs never become rows. Links give the components.

Tokens that lie in one component only offer nothing any more, so that groups of copies cost what their documents do
and not their pairs. Links that change no component are not listed.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A set has the distinct shingles, or, with fewer words, the whole sequence;
without words (null, empty) it is empty and linked with nothing. Tokens are 64-bit hashes, equal sets 128-bit ones.
Rows that share an id are linked by it, whatever their texts. A row without id is told the component of its set's
other rows, null if there are none, and links nothing. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seen
from .components import components
from .scratch import dropped, stored
from .words import MULT_A, MULT_B, mixed, rolling, slices, texts, word_hashes

#: Tokens that a task sees in so many of its documents go last in the order.
OFTEN = 8
#: Documents and tokens of a bucket at most, on average.
GROUP = 128
GROUP_TOKENS = 100_000
#: Offers to a hub that one task meets, on average.
OFFERS = 64
#: Groups that hold a token at most, if they are to meet in pairs of rows; more meet in blocks of about BLOCK_GROUPS.
LIGHT = 16
BLOCK_GROUPS = 512
#: Tokens that a task holds at once while it counts them.
COUNTED = 1 << 23
#: Names of sets that a task remembers; forgetting them costs copies, no result.
KEPT_NAMES = 200_000
_NO_ID = 1 << 63
#: Columns of the bit matrix that are multiplied at once, and cells of a matrix of common tokens.
_BLOCK = 1 << 14
_CELLS = 1 << 22


class Order:
    """The global order of tokens: rare ones by hash, then the frequent ones by rising level of frequency and hash."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        at = np.argsort(tokens, kind="stable")
        self.tokens, self.levels = tokens[at], levels[at]
        self.table = np.zeros(1 << 20, bool)
        self.table[self.tokens >> np.uint64(44)] = True

    def level(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        may = np.flatnonzero(self.table[tokens >> np.uint64(44)])
        if len(may):
            at = np.minimum(np.searchsorted(self.tokens, tokens[may]), len(self.tokens) - 1)
            out[may] = np.where(self.tokens[at] == tokens[may], self.levels[at], 0)
        return out


class Sets:
    """The shingle sets of some texts: tokens sorted within each set, with owner and first place of each set."""

    def __init__(self, texts_: list[bytes], k: int):
        words = [t.lower().split() for t in texts_]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        h = word_hashes([w for ws in words for w in ws])
        owner = np.repeat(np.arange(len(words)), counts)
        runs = rolling(h, k)
        own = owner[: len(runs)] == owner[k - 1 :] if len(runs) else np.zeros(0, bool)
        tokens, owner_ = runs[own], owner[: len(runs)][own]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            starts = np.cumsum(counts) - counts
            tokens = np.concatenate([tokens, *(rolling(h[starts[i] : starts[i] + counts[i]], int(counts[i])) for i in short)])
            owner_ = np.concatenate([owner_, short])
            at = np.argsort(owner_, kind="stable")
            tokens, owner_ = tokens[at], owner_[at]
        edges = np.searchsorted(owner_, np.arange(len(words) + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            tokens[a:b].sort()
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (owner_[1:] != owner_[:-1])
        self.tokens, self.owner = tokens[keep], owner_[keep]
        self.n = np.bincount(self.owner, minlength=len(words)).astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n

    def names(self) -> list[np.ndarray]:
        """Two 64-bit hashes of each set."""
        out = []
        for x in (mixed(self.tokens * MULT_A), mixed(self.tokens ^ MULT_B)):
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]
            out.append((sums[self.starts + self.n] - sums[self.starts]).view(np.int64))
        return out

    def prefixes(self, order: Order, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
        """The prefix tokens of all sets, in order, and their owners."""
        level = order.level(self.tokens)
        ranked = self.tokens.copy()
        for i in np.unique(self.owner[level > 0]).tolist():
            a, b = self.starts[i], self.starts[i] + self.n[i]
            ranked[a:b] = ranked[a:b][np.argsort(level[a:b], kind="stable")]
        length = self.n - needed(self.n, numerator, denominator) + shared_least(self.n)
        inside = np.arange(len(ranked)) - self.starts[self.owner] < length[self.owner]
        return ranked[inside], self.owner[inside]


def needed(n, numerator: int, denominator: int):
    """The least overlap of a set of n tokens with one similar enough to it."""
    return -(-n * numerator // denominator)


#: l as a share of n: a sixth.
PREFIX_PART = 6


def shared_least(n):
    """l of a set of n tokens."""
    return np.maximum(1, n // PREFIX_PART)


def frequent_tokens(slim: DataFrame, k: int) -> Broadcast:
    """The order, broadcast. Every task counts its own tokens over all its documents and tells those it sees OFTEN times;
    a token in more than a fixed share of documents is told by some task, and those are few, however many documents there are:
    at most (mean set size) x (documents a task) / OFTEN, of which the driver keeps the most frequent million. The order only
    decides how much there is to verify, never the result."""

    def often(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        found.clear()
        every.sort()
        new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
        n = np.diff(np.r_[new, len(every)])
        keep = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(every[new[keep]].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, x in _sets(batch, k):
                found.append(x.tokens)
                held += len(x.tokens)
                if held >= COUNTED:
                    yield often(found)
                    held = 0
        yield often(found)

    counts = slim.mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.select("token", F.floor(F.log2("n")).cast("int").alias("level")).orderBy(F.desc("level"), "token").limit(1_000_000).toArrow()
    return slim.sparkSession.sparkContext.broadcast(Order(top["token"].to_numpy().astype(np.int64).view(np.uint64), top["level"].to_numpy().astype(np.int64)))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for part in slices(batch, "text"):
        yield part, Sets(texts(part), k)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values.view(np.int64)))


def linked(a_n, b_n, shared, numerator: int, denominator: int):
    """Whether shared / union reaches numerator / denominator."""
    return denominator * shared >= numerator * (a_n + b_n - shared)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by `names` again, cut so that no run of equal values is in two of them."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        values = [batch.column(n).to_numpy() for n in names]
        last = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values]))
        edge = int(last[-1]) + 1 if len(last) else 0
        if edge:
            yield batch.slice(0, edge)
        held = batch.slice(edge)
    if held is not None:
        yield held


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the edges of its rows among them."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common columns of each row of one bit matrix and each of another."""
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], _BLOCK):
        out += a[:, at : at + _BLOCK].astype(np.float32) @ b[:, at : at + _BLOCK].astype(np.float32).T
    return out.astype(np.int64)


def _connected(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that it is connected with."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label, len(label)).min(axis=1)
        if (new == label).all():
            return label
        label = new


#: A row of the matrix: the group (its least id), its members, their sizes, what they must share with a partner at
#: least, the union of their prefixes and of their sets, and a row of bits for each member over the latter.
MATRIX = "g long, ids array<long>, ns array<long>, least long, prefix array<long>, union array<long>, held binary"


def _bits(held: bytes, members: int, columns: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held, np.uint8).reshape(members, -1), axis=1, count=columns)


def token_groups(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For documents sorted by key, bucket, a, b, n and id: the MATRIX rows of each bucket's groups."""

    def groups(ids, ns, least, prefixes, sets) -> Iterator[tuple]:
        if len(ids) == 1:
            yield ids[0], ids, ns, least[0], prefixes[0], sets[0], np.packbits(np.ones(len(sets[0]), np.uint8)).tobytes()
            return
        union, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros((len(ids), len(union)), np.uint8)
        held[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), inverse] = 1
        label = _connected(linked(ns[:, None], ns[None, :], _overlaps(held, held), numerator, denominator))
        for group in np.unique(label):
            own = np.flatnonzero(label == group)
            own = own[np.argsort(ids[own])]
            part = held[own]
            some = part.any(axis=0)
            prefix = np.unique(np.concatenate([prefixes[i] for i in own]))
            yield ids[own[0]], ids[own], ns[own], least[own].min(), prefix, union[some], np.packbits(part[:, some], axis=1).tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("ids", "ns")), ("least", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("prefix", "union")), ("held", pa.binary())])
        for batch in _runs(batches, ["key", "bucket"]):
            key, bucket, a, b, n, ids, least = (batch.column(x).to_numpy() for x in ("key", "bucket", "a", "b", "n", "id", "least"))
            prefix, prefix_at = _values(batch.column("prefix"))
            tokens, tokens_at = _values(batch.column("tokens"))
            new_run = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
            first = np.flatnonzero(new_run | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])])
            edges = np.r_[np.flatnonzero(new_run[first]), len(first)]
            rows: list[tuple] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = first[lo:hi]
                rows += groups(ids[at], n[at], least[at], [prefix[prefix_at[i] : prefix_at[i + 1]] for i in at], [tokens[tokens_at[i] : tokens_at[i + 1]] for i in at])
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return made


def _edges(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where the runs of equal `names` begin, and the end."""
    values = [batch.column(n).to_numpy() for n in names]
    return np.r_[0, np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1, len(batch)]


_MEETING = ["token", "i", "j"]


def met_groups(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For groups sorted by token, i and j, those of blocks i and j of the token: of these (token, i, j, block, g, component)
    of the groups that may have a link into another component, by their sizes, what they have in common at most, and as the
    token is the first one of `met` that the two share. `short` has 16 bits of each token that a group shares with others:
    two groups share no more tokens than these have in common, each as often as both have it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, _MEETING):
            token, i, j, block, g, component, least, lo, hi = (batch.column(x).to_numpy() for x in (*_MEETING, "block", "g", "component", "least", "lo", "hi"))
            short, short_at = _values(batch.column("short"))
            met, met_at = _values(batch.column("met"))
            edges = _edges(batch, _MEETING)
            kept = np.zeros(len(batch), bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x, y = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                if not len(x) or not len(y):
                    continue
                u, v = a + x[:, None], a + y[None, :]
                may = (component[u] != component[v]) & (denominator * hi[u] >= numerator * lo[v]) & (denominator * hi[v] >= numerator * lo[u])
                if i[a] == j[a]:
                    may &= g[u] < g[v]
                every = np.arange(b - a)
                if may.any():
                    tokens, of = met[met_at[a] : met_at[b]], np.repeat(every, np.diff(met_at[a : b + 1]))
                    before = tokens < token[a]
                    may &= ~before.any() or _shared(tokens[before], of[before], x, y) == 0
                if may.any():
                    own, of = _numbered(short[short_at[a] : short_at[b]], np.repeat(every, np.diff(short_at[a : b + 1])))
                    may &= _shared(own, of, x, y) >= np.minimum(least[u], least[v])
                kept[a + x[may.any(axis=1)]] = True
                kept[a + y[may.any(axis=0)]] = True
            yield batch.select([*_MEETING, "block", "g", "component"]).filter(pa.array(kept))

    return found


def _numbered(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 16 bits that an owner may have several times, told apart by their number; and the owners."""
    order = np.lexsort((values, owner))
    values, owner = values[order].astype(np.int64), owner[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]
    at = np.arange(len(values))
    return values + ((at - np.maximum.accumulate(np.where(new, at, 0))) << 17), owner


def opened_blocks(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For what met_groups keeps, with the rest of the MATRIX rows: (x, y), groups that links connect, each with the first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, _MEETING):
            g, component, held = batch.column("g").to_numpy(), batch.column("component").to_numpy(), batch.column("held")
            ns, ns_at = _values(batch.column("ns"))
            union, union_at = _values(batch.column("union"))
            edges = _edges(batch, _MEETING)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                of = lambda k: (ns[ns_at[a + k] : ns_at[a + k + 1]], union[union_at[a + k] : union_at[a + k + 1]], held[a + k].as_py())  # noqa: B023, E731
                every = np.arange(b - a)
                both = _shared(union[union_at[a] : union_at[b]], np.repeat(every, np.diff(union_at[a : b + 1])), every, every)
                lo = np.array([of(k)[0].min() for k in every])
                single = np.diff(ns_at[a : b + 1]) == 1
                apart = component[a:b][:, None] != component[a:b][None, :]
                links = apart & single[:, None] & single[None, :] & linked(lo[:, None], lo[None, :], both, numerator, denominator)
                links |= links.T
                label = _connected(links | np.eye(b - a, dtype=bool))
                # Groups of several members are opened one by one, unless they are connected by now.
                may = apart & ~(single[:, None] & single[None, :]) & (both >= needed(np.minimum(lo[:, None], lo[None, :]), numerator, denominator))
                for p, q in np.argwhere(np.triu(may)).tolist():
                    if label[p] != label[q] and opened(of(p), of(q), numerator, denominator):
                        label[label == label[q]] = label[p]
                join = np.flatnonzero(label != every)
                yield pa.RecordBatch.from_arrays([pa.array(g[a + join]), pa.array(g[a + label[join]])], names=["x", "y"])

    return found


def opened(x: tuple, y: tuple, numerator: int, denominator: int) -> bool:
    """Whether a link joins two groups, each of sizes, union and bits: y is opened to those members of x whose overlap with
    its union leaves one possible."""
    (n, u, held), (m, v, h_held) = x, y
    _, at, h_at = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    least = needed(n, numerator, denominator)
    if len(at) < least.min():
        return False
    queries = _bits(held, len(n), len(u))[:, at]
    opens = np.flatnonzero(queries.sum(axis=1, dtype=np.int64) >= least)
    if not len(opens):
        return False
    members = _bits(h_held, len(m), len(v))[:, h_at]
    return bool(linked(n[opens][:, None], m[None, :], _overlaps(queries[opens], members), numerator, denominator).any())


def _shared(tokens: np.ndarray, owner: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many tokens the sets `rows` and the sets `columns` of some owners share."""
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    many = counts > 1
    number = np.cumsum(many) - 1
    keep = many[inverse]
    at, owner = number[inverse[keep]], owner[keep]
    out, n, size = np.zeros((len(rows), len(columns)), np.float32), int(many.sum()), int(max(rows.max(), columns.max())) + 1
    order = np.argsort(at, kind="stable")
    at, owner, step = at[order], owner[order], max(1, _CELLS // size)
    for lo in range(0, n, step):
        own = slice(*np.searchsorted(at, [lo, lo + step]))
        full = np.zeros((size, min(step, n - lo)), np.float32)
        full[owner[own], at[own] - lo] = 1
        out += full[rows] @ full[columns].T
    return out.astype(np.int64)


def opened_groups(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For pairs of MATRIX rows, the columns of the second one named h, h_ns, h_union and h_held: (x, y), those groups
    that a link joins. The second group is opened to the members of the first whose overlap with its union leaves a link
    possible."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, h = batch.column("g").to_numpy(), batch.column("h").to_numpy()
            ns, ns_at = _values(batch.column("ns"))
            h_ns, h_ns_at = _values(batch.column("h_ns"))
            union, union_at = _values(batch.column("union"))
            h_union, h_union_at = _values(batch.column("h_union"))
            held, h_held = batch.column("held"), batch.column("h_held")
            join = np.zeros(len(g), bool)
            for i in range(len(g)):
                x = ns[ns_at[i] : ns_at[i + 1]], union[union_at[i] : union_at[i + 1]], held[i].as_py()
                y = h_ns[h_ns_at[i] : h_ns_at[i + 1]], h_union[h_union_at[i] : h_union_at[i + 1]], h_held[i].as_py()
                join[i] = opened(x, y, numerator, denominator)
            yield pa.RecordBatch.from_arrays([pa.array(g[join]), pa.array(h[join])], names=["x", "y"])

    return found


def document_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, numerator: int = 85, denominator: int = 100, log2_bits: int = seen.LOG2_BITS) -> DataFrame:
    """id_col, n_shingles and component_id, the smallest id reachable by links of Jaccard similarity numerator / denominator or more."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = frequent_tokens(slim.select("text"), k)

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and the notes of the prefix tokens."""
        names = ["id", "n", "a", "b", "segment", "once", "twice"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        tokens, held = [], 0

        def notes() -> Iterator[pa.RecordBatch]:
            for x in seen.noted(iter(tokens), log2_bits):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), t) for t in types[:4]] + x.columns, names=names)
            tokens.clear()

        for batch in batches:
            for part, sets in _sets(batch, k):
                tokens.append(sets.prefixes(order.value, numerator, denominator)[0])
                held += len(tokens[-1])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets.n), *map(pa.array, sets.names()), *(pa.nulls(len(part), t) for t in types[4:])], names=names)
                if held >= COUNTED:
                    yield from notes()
                    held = 0
        yield from notes()

    first = stored(slim.mapInArrow(noted, "id long, n long, a long, b long, " + seen.NOTES), "jaccard_first")
    bits = seen.twice_filter(first.where("segment IS NOT NULL"), log2_bits)
    known = first.where("segment IS NULL").select("id", "n", "a", "b")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that may be linked with another one; of a task's equal sets those whose id is less than all before."""
        least_ids: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part, sets in _sets(batch, k):
                tokens, owner = sets.prefixes(order.value, numerator, denominator)
                may = seen.suspected(tokens, bits.value, log2_bits)
                tokens, owner = tokens[may], owner[may]
                least = shared_least(needed(sets.n, numerator, denominator))  # of any partner's l and its own
                size = np.bincount(owner, minlength=len(part))
                good = (sets.n > 0) & (size >= least)
                ids, (a, b) = part.column("id").to_numpy(), sets.names()
                for i in np.flatnonzero(good).tolist():
                    name = (int(a[i]), int(b[i]))
                    if good[i] and ids[i] < least_ids.get(name, _NO_ID):
                        if len(least_ids) >= KEPT_NAMES:
                            least_ids.clear()
                        least_ids[name] = ids[i]
                    else:
                        good[i] = False
                at = np.flatnonzero(good)
                if len(at):
                    inside, whole = good[owner], good[sets.owner]
                    ends = np.cumsum(size[at])
                    key = tokens[inside][ends - size[at]].view(np.int64)
                    arrays = [pa.array(key), pa.array(ids[at]), pa.array(sets.n[at]), pa.array(a[at]), pa.array(b[at]), pa.array(least[at])]
                    yield pa.RecordBatch.from_arrays([*arrays, _lists(tokens[inside], size[at]), _lists(sets.tokens[whole], sets.n[at])], names=["key", "id", "n", "a", "b", "least", "prefix", "tokens"])

    found = stored(slim.where("id IS NOT NULL").mapInArrow(candidates, "key long, id long, n long, a long, b long, least long, prefix array<long>, tokens array<long>"), "jaccard_found")
    hot = found.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("buckets")).where("buckets > 1")
    hot = stored(hot, "jaccard_hot")
    dealt = found.join(hot, "key", "left").withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.coalesce("buckets", F.lit(1)))).drop("buckets")
    dealt = dealt.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "a", "b", "n", "id")
    matrix = stored(dealt.mapInArrow(token_groups(numerator, denominator), MATRIX), "jaccard_matrix")
    dropped(found, hot)

    # Exact counts of the prefix tokens, over groups: those of one group go, and so do groups left with fewer than they
    # must share. Of q tokens of which `least` must be shared, the first q - least + 1 hold one that is, in any order;
    # here the rarest first.
    every = matrix.select("g", "least", F.array_min("ns").alias("lo"), F.array_max("ns").alias("hi"), F.explode("prefix").alias("token"))
    counts = every.groupBy("token").agg(F.count("*").alias("m"), F.min("g").alias("hub")).where("m > 1")
    own = every.join(counts, "token").groupBy("g", "least", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("m", "token", "hub"))).alias("q")).where(F.size("q") >= F.col("least"))
    own = stored(own.select("g", "least", "lo", "hi", F.array_max("q.m").alias("most"), F.col("q.token").alias("q"), F.slice("q.hub", F.lit(1), (F.size("q") - F.col("least") + 1).cast("int")).alias("hubs")), "jaccard_slots")
    slots = own.select("g", "most", F.explode(F.zip_with("hubs", F.slice("q", F.lit(1), F.size("hubs")), lambda hub, token: F.struct(token.alias("token"), hub.alias("hub")))).alias("s")).select("g", "most", "s.token", "s.hub")

    def joined(pairs: DataFrame) -> DataFrame:
        """Of the pairs (g, h, most) of groups those that a link joins, as x and y. A group that `most` others may meet is
        copied, so that no task gets them all."""
        parts = F.ceil(F.col("most") / OFFERS).cast("int")
        pairs = pairs.select("g", "h", F.pmod(F.xxhash64("g"), parts).cast("int").alias("part"), parts.alias("parts")).distinct()
        copies = pairs.groupBy("h").agg(F.max("parts").alias("parts")).select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = matrix.select(F.col("g").alias("h"), F.col("ns").alias("h_ns"), F.col("union").alias("h_union"), F.col("held").alias("h_held"))
        both = pairs.select("g", "h", "part").join(matrix.select("g", "ns", "union", "held"), "g").join(copies.join(right, "h"), ["h", "part"])
        return stored(both.mapInArrow(opened_groups(numerator, denominator), "x long, y long"), "jaccard_links")

    most = own.select(F.col("g").alias("hub"), "most")
    offers = stored(slots.where("g <> hub").select("g", "hub").distinct().join(most, "hub").select("g", F.col("hub").alias("h"), "most"), "jaccard_offers")
    links = joined(offers)

    # Groups of different components, by the tokens of their slots that lie in several.
    part = components(links, "x", "y").withColumnsRenamed({"node": "g"})
    placed = stored(slots.join(part, "g", "left").select("g", "most", "token", F.coalesce("component", "g").alias("component")), "jaccard_placed")
    held = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("g")).alias("a"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("b"))
    held = stored(held.where("lo <> hi").select("token", "m", "a", "b"), "jaccard_held")
    brief = own.select("g", "least", "q", "lo", "hi")
    alike = lambda x, y: (denominator * F.col(f"{x}hi") >= numerator * F.col(f"{y}lo")) & (denominator * F.col(f"{y}hi") >= numerator * F.col(f"{x}lo"))

    light = placed.join(held.where(F.col("m") <= LIGHT).select("token"), "token").groupBy("token").agg(F.collect_list(F.struct("g", "component", "most")).alias("held"))
    others = lambda x: F.filter("held", lambda y: (x["g"] < y["g"]) & (x["component"] != y["component"]))
    pairs = F.flatten(F.transform("held", lambda x: F.transform(others(x), lambda y: F.struct(x["g"].alias("g"), y["g"].alias("h"), y["most"].alias("most")))))
    met = light.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    met = met.join(offers.select(F.col("h").alias("g"), F.col("g").alias("h")), ["g", "h"], "left_anti")
    both = met.join(brief, "g").join(brief.select(*[F.col(c).alias(f"h_{c}") for c in brief.columns]).withColumnRenamed("h_g", "h"), "h")
    near = both.where(alike("", "h_") & (F.size(F.array_intersect("q", "h_q")) >= F.least("least", "h_least"))).select("g", "h", "most")

    near = stored(near, "jaccard_met")
    links = links.unionByName(joined(near))
    dropped(near)

    # A token that many groups hold deals them into blocks, and a task meets two blocks. Of tokens that the same groups
    # hold one is enough. Small inputs have no such token.
    common = held.where(F.col("m") > LIGHT)
    if not common.isEmpty():
        heavy = common.groupBy("m", "a", "b").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("m") / BLOCK_GROUPS).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(F.col("block"), x).alias("i"), F.greatest(F.col("block"), x).alias("j")))
        at = placed.join(heavy, "token").select("token", "blocks", "g", "component")
        met = at.groupBy("g").agg(F.collect_list("token").alias("met"))
        own_brief = brief.select("g", "least", "lo", "hi", F.transform("q", lambda t: (t % 32768).cast("short")).alias("short")).join(met, "g")
        dealt = at.withColumn("block", block).withColumn("pair", F.explode(pair)).join(own_brief, "g")
        dealt = dealt.select("token", "pair.i", "pair.j", "block", "g", "component", "least", "lo", "hi", "short", "met")
        in_meetings = lambda df: df.repartition(*_MEETING).sortWithinPartitions(*_MEETING)
        crowd = stored(in_meetings(dealt).mapInArrow(met_groups(numerator, denominator), "token long, i int, j int, block int, g long, component long"), "jaccard_crowd")
        more = in_meetings(crowd.join(matrix.select("g", "ns", "union", "held"), "g")).mapInArrow(opened_blocks(numerator, denominator), "x long, y long")
        links = links.unionByName(stored(more, "jaccard_links"))
        dropped(crowd)
    dropped(offers, own)

    # Back to every document: its group, its set, and the rows that share its id.
    grouped = matrix.select("g", F.explode("ids").alias("first"))
    grouped = grouped.join(components(links, "x", "y").withColumnsRenamed({"node": "g"}), "g", "left").select("first", F.coalesce("component", "g").alias("component"))
    classes = known.where("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("first"))
    classes = classes.join(grouped, "first", "left").select("a", "b", "n", F.coalesce("component", "first").alias("component"))
    rows = known.join(classes, ["a", "b", "n"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    rows = stored(rows, "jaccard_classes")
    dropped(first, matrix, placed, held)
    shared = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("hi")).where("x <> hi").select("id", "x")
    shared = stored(shared, "jaccard_shared_ids")
    if not shared.isEmpty():
        more = rows.join(shared, "id").select("x", F.col("component").alias("y"))
        again = components(more, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("joined"))
        rows = rows.join(again, "component", "left").select("id", "n", F.coalesce("joined", "component").alias("component"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
