"""Alignment of two tokenizers' ids over the same bytes: which tokens of A lie on which tokens of B, and how often they meet.

A is a byte-level file of tokenizers, given a space and the text; B is a sentencepiece model, which adds the space itself. Whole
texts are tokenised. Where an A and a B token end at the same byte and both next tokens begin with a space, the text falls into
windows of token ids; what is worked out for a window (its groups, cut where both end, and its links, the pairs of tokens whose
bytes overlap) is remembered by the window's ids, so that a word costs once a worker.

The two tokenisations of a word surrounded by single spaces or after a line break do not depend on its neighbours (a byte-level pattern
starts anew at each, and no piece of B may hold a space after its first character or a line break, which is checked when the
model is read). New words of a batch are therefore encoded together, each once; all other texts are encoded whole.

A pair's count is the number of documents that have it linked; it is counted by Spark and joined back in tasks, MOST_PAIRS pairs
at a time, so that what is broadcast has a bound.

A text that is null or empty, or whose joined token bytes of A or B are not a space and the text, has no tokens: its numbers are 0 and
its groups ''. Rows are independent, repeated ones and those without id too; each counts as a document. An empty table gives no
rows; other columns than id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, stored
from .words import slices

#: Words, and windows, that a worker keeps; each is emptied when full.
CACHED_WORDS = 300_000
CACHED_WINDOWS = 200_000
#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: Pairs of ids whose counts are broadcast at once: 16 bytes each.
MOST_PAIRS = 1 << 22
#: Marks ids of B in a window's key.
_B = 1 << 31
#: Printable ASCII and the letters of Latin-1 and Latin Extended-A and -B, on which no Unicode tables differ.
_PLAIN = re.compile("\n?[!-~¡¿«»À-ÖØ-öø-ɏ]+")
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones for themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; one a worker and pair of files."""

    _known: dict = {}

    @classmethod
    def of(cls, a_path: str, b_path: str, ranks: str | None = None) -> Tokenizers:
        if (a_path, b_path, ranks) not in cls._known:
            cls._known[a_path, b_path, ranks] = cls(a_path, b_path, ranks)
        return cls._known[a_path, b_path, ranks]

    def __init__(self, a_path: str, b_path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary, letters = self.a.get_vocab(), _byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.a_spaced, self.b_spaced = (np.fromiter((t.startswith(b" ") for t in x), bool, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.by_words = not any(re.search("[^ ] |\n", t.decode(errors="replace")) for i, t in enumerate(self.b_bytes) if not self.b.is_byte(i))
        self.space = self.b.piece_to_id("▁")
        self.encode_a = lambda text: self.a.encode(text, add_special_tokens=False).ids
        if ranks:  # the same vocabulary, read faster; the ids are the same
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
            self.encode_a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def _learn(self, new: list[str]) -> None:
        """Both ids (little-endian uint32) of words led by a line break or else by a space; None where a word is not plain."""
        plain = [w for w in new if _PLAIN.fullmatch(w) and "<|" not in w]
        self.words.update(dict.fromkeys(new))
        if not plain:
            return
        led = [(w if w[0] == "\n" else f" {w}").encode() for w in plain]
        whole = b"".join(led)
        ids = np.array(self.encode_a(whole.decode()), np.uint32)
        if b"".join(map(self.a_bytes.__getitem__, ids.tolist())) != whole:
            return
        token_ends, word_ends = np.cumsum(self.a_length[ids]), np.cumsum([len(x) for x in led])
        last = np.searchsorted(token_ends, word_ends)
        cut = token_ends[np.minimum(last, len(token_ends) - 1)] == word_ends
        raw, starts = ids.astype("<u4").tobytes(), np.r_[0, last[:-1] + 1]
        b_ids, b_cuts, sound = self._pieces(plain, led)
        sound &= cut & np.r_[True, cut[:-1]]
        spans = zip(plain, *((4 * x).tolist() for x in (starts, last + 1, b_cuts[:-1], b_cuts[1:])), sound.tolist())
        self.words.update((w, (raw[i:j], b_ids[k:n])) for w, i, j, k, n, ok in spans if ok)

    def _pieces(self, plain: list[str], led: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """B's ids of the words after each other, where each begins, and which words' bytes they have. The space before a line
        break is left out."""
        found = self.b.encode(plain, num_threads=1)
        cuts = np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        ids = np.fromiter(chain.from_iterable(found), np.int64, cuts[-1])
        broken = np.fromiter((w[0] == "\n" for w in plain), bool, len(plain))
        ends = np.r_[0, np.cumsum(self.b_length[ids])][cuts]
        sound = (np.diff(ends) == np.fromiter(map(len, led), np.int64, len(led)) + broken) & ~(broken & (ids[cuts[:-1]] != self.space))
        said = b"".join(map(self.b_bytes.__getitem__, ids.tolist()))
        if said != b"".join([b" " + x if x[:1] == b"\n" else x for x in led]):
            sound &= [said[i + n : j] == x for i, j, n, x in zip(ends[:-1].tolist(), ends[1:].tolist(), broken.tolist(), led)]
        kept = np.ones(len(ids), bool)
        kept[cuts[:-1][broken]] = False
        return ids[kept].astype("<u4").tobytes(), cuts - np.r_[0, np.cumsum(broken)], sound

    def encoded(self, texts: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """Both ids of each text as little-endian uint32, or None where it has no tokens."""
        said = [t.decode("utf-8", "replace") for t in texts]
        split = [t.replace("\n", " \n").split(" ") if t and self.by_words else [] for t in said]
        every = set().union(*split)
        if len(self.words) + len(every) > CACHED_WORDS:
            self.words = {w: self.words[w] for w in every if w in self.words}
        self._learn([w for w in every if w not in self.words])
        out: list[tuple[bytes, bytes] | None] = []
        for raw, text, words in zip(texts, said, split):
            known = list(map(self.words.__getitem__, words))
            if not text:
                out.append(None)
            elif known and None not in known and raw == text.encode():
                out.append((b"".join([k[0] for k in known]), b"".join([k[1] for k in known])))
            else:
                a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
                same = b"".join(map(self.a_bytes.__getitem__, a)) == b" " + raw == b"".join(map(self.b_bytes.__getitem__, b))
                out.append((array("I", a).tobytes(), array("I", b).tobytes()) if same else None)
        return out


class Windows:
    """The number of a window by its ids; what is known of the windows stands in columns."""

    def __init__(self, of: Tokenizers):
        self.of, self.width = of, len(of.b_bytes)
        #: Of each number how it is written before another token of its side, the other side, another group and another window.
        self.written = [f"{i}{end}" for end in ",|;\n" for i in range(max(len(of.a_bytes), self.width))]
        self.emptied()

    def emptied(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.groups, self.links, self.starts, self.codes, self.text = array("q"), array("q"), array("q", [0]), array("q"), []

    def numbered(self, keys: list[bytes]) -> np.ndarray:
        """The windows' numbers; all new ones are aligned at once."""
        if new := [k for k in dict.fromkeys(keys) if k not in self.numbers]:
            self.numbers.update(zip(new, range(len(self.text), len(self.text) + len(new))))
            self._learn(new)
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))

    def _learn(self, keys: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
        of_b = ids >= _B
        a, b = ids[~of_b], ids[of_b] - _B
        a_ends, b_ends = np.cumsum(self.of.a_length[a]), np.cumsum(self.of.b_length[b])
        key_ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys))) // 4
        window_ends = b_ends[np.cumsum(of_b)[key_ends - 1] - 1]
        ends = np.union1d(a_ends, b_ends)  # between two of these lies one token of A on one of B: a link
        self.codes.extend((a[np.searchsorted(a_ends, ends)] * self.width + b[np.searchsorted(b_ends, ends)]).tolist())
        links = np.searchsorted(ends, window_ends) + 1
        self.links.extend(np.diff(np.r_[0, links]).tolist())
        self.starts.extend((self.starts[-1] + links).tolist())
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last = np.searchsorted(cuts, window_ends)
        self.groups.extend(np.diff(np.r_[-1, last]).tolist())
        # What is written: group by group the tokens of A, then those of B.
        a_last, b_last = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        a_of, b_of = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n = len(self.written) // 4
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[a_last], end_b[b_last] = 1, 2
        end_b[b_last[last]] = 3
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.r_[0, b_last + 1][a_of]] = a + n * end_a
        out[np.arange(len(b)) + a_last[b_of] + 1] = b + n * end_b
        self.text.extend("".join(map(self.written.__getitem__, out.tolist())).split("\n")[:-1])


def _aligned(texts: list[bytes], of: Tokenizers, memo: Windows) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, ...]]:
    """Of each text _NUMBERS and its groups; and of all texts the owner, A id, B id and number of links of each linked pair of ids."""
    found = of.encoded(texts)
    held = [i for i, f in enumerate(found) if f]
    numbers, told = [np.zeros(len(texts), np.int64) for _ in _NUMBERS], [""] * len(texts)
    if not held:
        return numbers, told, (np.zeros(0, np.int64),) * 4
    a, b = (np.frombuffer(b"".join([found[i][k] for i in held]), "<u4").astype(np.int64) for k in (0, 1))
    a_ends, b_ends = np.cumsum(of.a_length[a]), np.cumsum(of.b_length[b])
    in_b = np.zeros(a_ends[-1] + 1, np.int64)
    in_b[b_ends] = np.arange(1, len(b) + 1)
    at_b = in_b[a_ends]
    a_last = np.flatnonzero(at_b)  # tokens of A that end where one of B does
    b_last = at_b[a_last] - 1
    spaced = np.r_[of.a_spaced[a], True][a_last + 1] & np.r_[of.b_spaced[b], True][b_last + 1]
    a_to, b_to = a_last[spaced] + 1, b_last[spaced] + 1  # texts begin with a space, so every text's end is one of these
    text_ends = np.cumsum([1 + len(texts[i]) for i in held])
    window_ends = a_ends[a_to - 1]
    a_raw, b_raw = a.astype("<u4").tobytes(), (b + _B).astype("<u4").tobytes()
    if len(memo.text) > CACHED_WINDOWS:
        memo.emptied()
    cuts = [(4 * np.r_[0, x]).tolist() for x in (a_to, b_to)]
    keys = [a_raw[i:j] + b_raw[k:n] for i, j, k, n in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
    which = memo.numbered(keys)
    del keys
    firsts = np.r_[0, np.searchsorted(window_ends, text_ends) + 1]
    groups, links, starts, codes = (np.frombuffer(x, np.int64) for x in (memo.groups, memo.links, memo.starts, memo.codes))
    numbers[0][held], numbers[1][held] = np.diff(np.r_[0, a_to[firsts[1:] - 1]]), np.diff(np.r_[0, b_to[firsts[1:] - 1]])
    numbers[2][held], numbers[3][held] = (np.add.reduceat(x[which], firsts[:-1]) for x in (groups, links))
    parts = list(map(memo.text.__getitem__, which.tolist()))
    for i, start, end in zip(held, firsts[:-1].tolist(), firsts[1:].tolist()):
        told[i] = ";".join(parts[start:end])
    size = links[which]
    at = np.repeat(starts[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    owner = np.repeat(np.arange(len(held)), np.diff(firsts))
    code = np.repeat(owner, size) * (len(of.a_bytes) * memo.width) + codes[at]
    code.sort()
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    times, code = np.diff(np.r_[new, len(code)]), code[new]
    owner, code = np.divmod(code, len(of.a_bytes) * memo.width)
    return numbers, told, (np.array(held)[owner], *np.divmod(code, memo.width), times)


def aligned(docs: DataFrame, a_path: str, b_path: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """The id with n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), their hash groups_sha256, and the linked pairs of ids as
    arrays a and b, with times, the number of links of each."""
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_field = slim.schema.fields[0]
    named = [*(f"{n} long" for n in _NUMBERS), *(["groups string"] if keep_groups else []), "groups_sha256 string", "a array<int>", "b array<int>", "times array<int>"]
    schema = T.StructType([T.StructField("doc_id", id_field.dataType), *(T._parse_datatype_string(", ".join(named)).fields)])
    names = schema.names

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizers.of(a_path, b_path, ranks)
        memo = Windows(of)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                numbers, told, (owner, a, b, times) = _aligned(texts, of, memo)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a, b, times)]
                hashed = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
                texts_out = [pa.array(told, pa.string())] if keep_groups else []
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, numbers), *texts_out, pa.array(hashed, pa.string()), *lists], names=names)

    return slim.mapInArrow(worked, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, the number of documents n that have the pair linked, and whether no other b is linked with a in more: best.

    An A id meets at most as many B ids as there are, which bounds the window's groups."""
    counts = found.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _sums(found: DataFrame, counts: pa.Table, passed: list[str]) -> DataFrame:
    """Columns of found with n_best and count_sum over the pairs that have a count here."""
    a, b, n, best = (counts[c].to_numpy() for c in ("a", "b", "n", "best"))
    order = np.lexsort((b, a))
    code = (a.astype(np.int64)[order] << 32) | b[order]
    sent = found.sparkSession.sparkContext.broadcast((code, np.where(best, n, -n)[order]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, signed = sent.value
        for batch in batches:
            lists = [batch.column(c) for c in ("a", "b", "times")]
            x, y, times = (c.flatten().to_numpy().astype(np.int64) for c in lists)
            ends = np.cumsum(lists[0].value_lengths().to_numpy())
            mine = (x << 32) | y
            at = np.minimum(np.searchsorted(code, mine), max(len(code) - 1, 0))
            n = np.where(code[at] == mine, signed[at], 0) if len(code) else np.zeros(len(mine), np.int64)
            total = [np.diff(np.r_[0, np.r_[0, np.cumsum(v)][ends]]) for v in (times * (n > 0), times * np.abs(n))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *map(pa.array, total)], names=[*passed, "n_best", "count_sum"])

    kept = found.select(*passed, "a", "b", "times")
    schema = T.StructType([*(f for f in found.schema.fields if f.name in passed), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return kept.mapInArrow(summed, schema)


def with_counts(found: DataFrame, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """What `aligned` found, a written table, with n_best and count_sum instead of the pairs.

    Up to most_pairs counts are broadcast. Where there are more, they go by parts: each pass adds up its part's counts for every row, and
    the rows' sums are joined back."""
    passed = [c for c in found.columns if c not in ("a", "b", "times")]
    counts = stored(pair_counts(found), "pair_counts")
    parts = max(1, -(-counts.count() // most_pairs))
    if parts == 1:
        return _sums(found, counts.toArrow(), passed)
    numbered = stored(found.withColumn("_row", F.monotonically_increasing_id()), "alignments")
    dealt = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    sums = [stored(_sums(numbered, counts.where(dealt == p).toArrow(), ["_row"]), "sums") for p in range(parts)]
    every = sums[0]
    for s in sums[1:]:
        every = every.unionByName(s)
    dropped(counts)
    total = every.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.select("_row", *passed).join(total, "_row").drop("_row")


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, ranks: str | None = None, **how) -> DataFrame:
    """`aligned` with the corpus's counts: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups and groups_sha256."""
    return with_counts(stored(aligned(docs, a_path, b_path, ranks, **how), "alignments"))
