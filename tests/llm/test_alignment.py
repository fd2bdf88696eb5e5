import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidlens.llm import alignment
from bidlens.llm.alignment import Tokenizers, aligned, with_counts
from bidlens.llm.queries import QUERIES, tokenizer_files
from bidlens.llm.scratch import stored

SF = "/root/testdata/sf0.001"
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
A_FILE, RANKS = tokenizer_files()
TEXTS = [
    None, "", " ", "  ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a \nb", "a\n\nb", "a\tb", "a\r\nb", "\na", "Hello, world! It's 2024.", "don't we'll I'M", "x" * 3000, "日本語 テキスト 日本", "é́ ﬁ ½ Ⅷ",
    "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "🙂🙃 👩‍👩‍👧", "a b c", "\x00\x01", "ſß ǅ Ɏ ɏ", "naïve — “quoted” … ok", "the the the the", "A\x0bB\x0cC", "﻿bom", "é 한",
    "word " * 500 + "end", "http://a.b/c?d=e&f=g#h", "1234567890 0x1F 3.14", "ÄÖÜ äöü ß\nNeue Zeile. Und noch", "tab\t\ttab", "trailing\n", "Ω≈ç√∫ word", "a" + "̀" * 50,
]


class Brute:
    """Character by character: what each byte's A and B token is."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in visible}
        for i, b in enumerate(b for b in range(256) if b not in visible):
            self.byte[chr(256 + i)] = b

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def rows(self, docs):
        linked, told = [], []
        for doc, text in docs:
            a, b = self.tokens(text)
            where, ends = [[], []], [set(), set()]
            for side, toks in enumerate((a, b)):
                for n, (_, raw) in enumerate(toks):
                    where[side] += [n] * len(raw)
                    ends[side].add(len(where[side]))
            links = Counter(a_b for a_b in set(zip(*where)))
            links = Counter((a[i][0], b[j][0]) for i, j in links)
            groups, at = [], 0
            for end in sorted(ends[0] & ends[1]):
                groups.append("|".join(",".join(str(toks[n][0]) for n in sorted(set(w[at:end]))) for toks, w in zip((a, b), where)))
                at = end
            linked.append(links)
            told.append((doc, len(a), len(b), len(groups), sum(links.values()), ";".join(groups)))
        count = Counter(p for x in linked for p in x)
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        return [(*t[:5], sum(n for p, n in x.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(t[5].encode()).hexdigest() if t[5] else "", t[5]) for t, x in zip(told, linked)]


@pytest.fixture(scope="module")
def brute():
    return Brute()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_words_and_whole_texts_are_tokenised_alike(brute):
    r = random.Random(3)
    of = Tokenizers.of(A_FILE, B_FILE, RANKS)
    assert of.by_words
    letters = "aábcdeß.,'’!1 2  \n\nĀɏ<|>▁é日"
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    plain = 0
    for text, got in zip(texts, of.encoded([t.encode() for t in texts])):
        a, b = brute.tokens(text)
        ids = [list(memoryview(x).cast("I")) for x in got] if got else [[], []]
        assert ids == [[i for i, _ in a], [i for i, _ in b]], text
        plain += bool(got) and all(of.words.get(w) for w in text.replace("\n", " \n").split(" "))
    assert plain > 100


def test_texts_like_brute_force(spark, brute, monkeypatch):
    docs = list(enumerate(TEXTS)) + [(None, "a b"), (1, "the end"), (1, "the end")]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("a", F.lit("x")).withColumn("GROUPS", F.lit(1)).withColumn("n", F.lit(0))
    want = sorted(brute.rows(docs), key=repr)
    found = stored(aligned(df.repartition(3), A_FILE, B_FILE, RANKS), "found")
    assert sorted((tuple(r) for r in with_counts(found).select(COLUMNS).collect()), key=repr) == want
    assert sorted((tuple(r) for r in with_counts(found, most_pairs=50).select(COLUMNS).collect()), key=repr) == want  # counts by parts
    whole = stored(aligned(df.repartition(3), A_FILE, B_FILE), "whole")  # without ranks
    assert sorted((tuple(r) for r in with_counts(whole).select(COLUMNS).collect()), key=repr) == want
    assert with_counts(stored(aligned(df.limit(0), A_FILE, B_FILE, RANKS), "none")).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert [tuple(r) for r in with_counts(stored(aligned(nulls, A_FILE, B_FILE, RANKS), "nulls")).select(COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", "")]


def test_caches_that_are_full_are_emptied(brute, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 3)
    monkeypatch.setattr(alignment, "CACHED_WINDOWS", 2)
    of = Tokenizers(A_FILE, B_FILE, RANKS)
    memo = alignment.Windows(of)
    for texts in (["one two three", "four five"], ["six one"], ["two six", "nine  ten"]):
        numbers, told, _ = alignment._aligned([t.encode() for t in texts], of, memo)
        want = brute.rows(list(enumerate(texts)))
        assert told == [w[8] for w in want] and [tuple(n[i] for n in numbers) for i in range(len(texts))] == [w[1:5] for w in want]
    assert len(of.words) <= 5


def test_documents(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_token_alignment"](spark, SF).select(COLUMNS[:-1]).collect())
    assert got == sorted(r[:-1] for r in brute.rows(docs))
    assert sum(r[5] for r in got)
