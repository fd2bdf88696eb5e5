"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count the n-grams of their labelled texts, a sum by language and bucket makes the model, and its matrix of
log-probabilities (languages x BUCKETS) is broadcast. Texts are scored in batches, by their n-grams' rows of the matrix. All
training texts count, whole; what reaches the driver is bounded by languages x BUCKETS, and more than MOST_LANGUAGES raise.

N-grams run over the lower-cased text in which every run of other characters than letters is one space. Null texts and
texts without a letter are `und` with score 0, as is everything when nothing was learned. The score is the posterior
probability of the language. Ties go to the first language by name. Rows are independent; repeated ones count each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

LOG2_BUCKETS = 16
BUCKETS = 1 << LOG2_BUCKETS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Bytes of text in a batch, and n-grams that are looked up at once.
SLICE = 1 << 19
BLOCK = 1 << 17
#: Languages of a model at most: its matrix has BUCKETS x languages numbers, collected and broadcast.
MOST_LANGUAGES = 256
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


class Grams:
    """The n-grams of a batch of texts: for each order their buckets and owners, and which texts have a letter."""

    def __init__(self, texts: list[str | None]):
        low = [f" {t.lower()} " if t else "  " for t in texts]
        self.n = len(texts)
        owner = np.repeat(np.arange(self.n), np.fromiter(map(len, low), np.int64, self.n))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        self.lettered = np.bincount(owner[letter], minlength=self.n) > 0
        # A run of others becomes one space, its first; every text begins and ends with one.
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
        keep[:1] = True
        keep &= self.lettered[owner]
        self.codes, self.owner = np.where(letter, codes, np.uint32(32))[keep], owner[keep]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = np.zeros(len(self.codes), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            size = max(0, len(self.codes) - n + 1)
            h = h[:size] * np.uint32(0x01000193) + self.codes[n - 1 :]
            if n in ORDERS and size:
                own = self.owner[:size] == self.owner[n - 1 :]
                x = (h[own] ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                yield x >> np.uint32(32 - LOG2_BUCKETS), self.owner[:size][own]


def gram_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n of labelled texts; bucket -1 has the number of texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Grams(part.column("text").to_pylist())
                langs = part.column("lang").dictionary_encode()
                names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
                for i, lang in enumerate(names):
                    totals[lang][BUCKETS] += np.count_nonzero(found.lettered[of == i])
                for buckets, owner in found:
                    for i, lang in enumerate(names):
                        totals[lang][:BUCKETS] += np.bincount(buckets[of[owner] == i] if len(names) > 1 else buckets, minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    return slim.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and log-probabilities by bucket and language with the prior in the last row."""

    def __init__(self, counts: pa.Table):
        self.langs = sorted(set(counts["lang"].to_pylist()))
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages, more than {MOST_LANGUAGES}: pool the rare ones first")
        at = {lang: i for i, lang in enumerate(self.langs)}
        total = np.zeros((BUCKETS + 1, len(self.langs)))
        total[counts["bucket"].to_numpy(), [at[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
        grams_ = total[:BUCKETS] + SMOOTHING
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log = np.vstack([np.log(grams_ / grams_.sum(axis=0)), np.log(total[BUCKETS] / total[BUCKETS].sum())])

    def scored(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, its posterior, and how likely its n-grams are there: the mean of their log-probabilities.

        A batch is one sparse matrix of n-grams: its rows of the log matrix are summed by text, BLOCK n-grams at a time."""
        found = Grams(texts)
        known = found.lettered if self.langs else np.zeros(len(texts), bool)
        if not known.any():
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for buckets, owner in found:
            n += np.bincount(owner, minlength=len(texts))
            for at in range(0, len(buckets), BLOCK):
                own = owner[at : at + BLOCK]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                sums[own[starts]] += np.add.reduceat(self.log[buckets[at : at + BLOCK]], starts, axis=0)
        scores = sums + self.log[BUCKETS]
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(texts)), best]
        with np.errstate(over="ignore"):
            posterior = np.where(known, 1 / np.exp(scores - top[:, None]).sum(axis=1), 0.0)
        mean = np.where(known, sums[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], posterior, mean


def fitted(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Broadcast:
    """A model of the labelled texts, broadcast."""
    counts = gram_counts(labelled, text_col=text_col, lang_col=lang_col).toArrow()
    return labelled.sparkSession.sparkContext.broadcast(Model(counts))


def with_language(docs: DataFrame, model: Broadcast, *, text_col: str = "text", likeness: str | None = None) -> DataFrame:
    """docs with lang_pred and score instead of any such columns; with `likeness`, the mean log-probability of the text's
    n-grams in its language is a column of that name."""
    added = ["lang_pred", "score", *([likeness] if likeness else [])]
    docs = docs.drop(*added)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                langs, scores, means = model.value.scored(part.column(text_col).to_pylist())
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(means, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new[: len(added)]], names=[*part.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.StringType() if n == "lang_pred" else T.DoubleType()) for n in added)])
    return docs.mapInArrow(predicted, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
