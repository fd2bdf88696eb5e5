"""Brute-force versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(rows, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        for key in {x.strip(BLANK).translate(LOWER) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(doc)
    keeper = {k: max(v, key=lambda d: -1 if d is None else d) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if (k := x.strip(BLANK).translate(LOWER)) not in keeper or keeper[k] == doc]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def substrings(rows, k=20):
    first = {}
    for doc, text in sorted(rows):
        w = WORD.findall(text or "")
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (doc, s))
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (doc, s):
                gone.update(range(s, s + k))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)
