"""Token ids of whole texts inside tasks, as a tokenizers file gives them."""

from __future__ import annotations

import base64
import os
import re
from array import array

#: Words whose ids a Python worker keeps of each kind; the cache is emptied when full.
CACHED_WORDS = 200_000
#: Printable ASCII and the letters of Latin-1 and Latin Extended-A and -B, on which no Unicode tables differ.
_PLAIN = re.compile("[!-~¡¿«»À-ÖØ-öø-ɏ]+")


class _Unusual(Exception):
    pass


class _Words(dict):
    """Ids (little-endian uint32) of a word, with a space before it or not."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            raise _Unusual
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(self.lead + word)).tobytes()
        return ids


class Encoder:
    """The ids of a byte-level BPE file of tokenizers.

    Its pattern never joins anything across a single space or line break between two visible characters, so
    a text made of plain words with single separators is encoded word by word, each word once a worker. Where
    the same vocabulary is at hand as ranks, tiktoken encodes these words (the ids are the same, the tests
    compare them); every other text goes whole through tokenizers.
    """

    _known: dict = {}

    @classmethod
    def of(cls, path: str, ranks: str | None = None) -> Encoder:
        if (path, ranks) not in cls._known:
            cls._known[path, ranks] = cls(path, ranks)
        return cls._known[path, ranks]

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        encode = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first, self.later = _Words(encode, ""), _Words(encode, " ")
        self.line = array("I", encode("\n")).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian uint32 ids of a text."""
        if not text:
            return b""
        first, later = self.first.__getitem__, self.later.__getitem__
        try:
            out = []
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(self.line)
                out.append(first(words[0]))
                out.extend(map(later, words[1:]))
            return b"".join(out[1:])
        except _Unusual:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
