import random
import re

from pyspark.sql import functions as F

from bidlens.llm.license_rules import RULES, SCORES
from bidlens.llm.licenses import scanned
from bidlens.llm.queries import QUERIES

from .brute import LOWER

SF = "/root/testdata/sf0.001"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    """Word by word."""
    w = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def every(text):
    """All rules on the whole text, without prefilter; each match against each other one."""
    w = WORD.findall((text or "").translate(LOWER))
    joined = " " + "".join(x + " " for x in w)
    found = []
    for i, r in enumerate(RULES):
        for m in re.finditer(r.pattern, joined, re.ASCII):
            start = joined.count(" ", 0, m.start()) - 1
            found.append((start, start + m[0].count(" ") + 1, r.rank, i))
    holds = lambda o, x: o[0] <= x[0] and x[1] <= o[1] and (o[2] < x[2] or o[2] == x[2] and (o[1] - o[0] > x[1] - x[0] or o[1] - o[0] == x[1] - x[0] and o[3] < x[3]))
    kept = [x for x in found if RULES[x[3]].base or not any(holds(o, x) for o in found)]
    told = sorted((s, e, rank, i) for s, e, rank, i in kept)
    return ",".join(sorted({RULES[i].label for *_, i in told})), max((SCORES[r] for _, _, r, _ in told), default=0.0), [(s, e, RULES[i].label, SCORES[r]) for s, e, r, i in told]


TEXTS = [
    None, "", " ", "...", "no license here", "MIT License", "the MIT-License/mit license,MIT\nLICENSE.", "mit licenses", "smit license", "éMIT License", "mit licensé",
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License v2.0 or (at your option) any later version", "GNU Lesser General Public License 2.1",
    "Apache License, Version 2.0", "Licensed under the Apache License", "apache\x00license", "CC-BY 4.0", "cc by-nc-sa 4.0", "CC BY", "cc by cc by cc by", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT-0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated", "https://www.apache.org/licenses/LICENSE-2.0.txt", "http://creativecommons.org/licenses/by-sa/3.0/",
    "All rights reserved. Copyright (c) 2019 Someone", "GPLv3 gplv2+ GPL-3.0-only LGPL 2.1", "BSD 3-Clause License; ISC license; zlib license", "日本 cc by 日本", "K mit license", "word\x01mit\x02license $0 \\1",
    "released into the public domain", "Creative Commons Attribution 4.0 International License", "mit license " * 300, "x " * 5000 + "Apache License " + "y " * 100, "the unlicense and WTFPL v2", "\x7fgnu{general}public~license",
    "ſ K", "İ gnu general public license",
]


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels), (r.labels, r.score, [tuple(d) for d in r.detections])


def same(got, text):
    own, (labels, score, found) = got
    assert own == base(text), text
    want = every(text)
    assert (labels, score) == want[:2] and sorted(found) == sorted(want[2]), text


def test_texts_like_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)
    df = df.withColumns({c: F.lit("x") for c in ("labels", "Score", "words", "hits", "found", "held_text", "doc_id")})
    for r in scanned(df).collect():
        same(row(r), r.text)
        assert r.words == r.hits == r.found == r.held_text == "x"
    assert scanned(df.limit(0)).count() == 0


def test_every_rule_has_its_keyword():
    """Without its keyword no rule can match: words from all patterns, with each keyword left out in turn."""
    r = random.Random(5)
    words = sorted({w for rule in RULES for w in re.findall("[a-z0-9]+", rule.pattern)})
    samples = ["mit license version 2 0", "apache org licenses license 2 0", "cc by nc nd 4 0", "creative commons attribution noncommercial sharealike 3 0", "gnu library general public licence v 2", "gpl v2 only", "open database license", "etalab license", "licence ouverte etalab", "wtfpl", "zlib libpng license", "bsd zero clause license", "copyright c 2020", "new bsd", "see license"]
    samples += [" ".join(r.choice(words) for _ in range(6)) for _ in range(500)] + [" ".join(re.findall("[a-z0-9]+", re.sub(r"\(\?[:<=!]+|\\.", " ", rule.pattern.replace("[cs]", "s").replace("{", "")))) for rule in RULES]
    for rule in RULES:
        for s in samples:
            m = re.search(rule.pattern, f" {s} ", re.ASCII)
            assert not m or rule.keyword in m[0].split(), (rule, s)


def test_random_words_like_brute_force(spark):
    r = random.Random(4)
    some = "gnu general public license licence mit apache version 2 3 0 1 or any later only lesser cc by nc sa nd 4 bsd clause spdx identifier gpl creative commons attribution the software of x".split()
    texts = [" ".join(r.choice(some) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    got = scanned(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)).collect()
    for x in got:
        same(row(x), x.text)
    assert len({x.labels for x in got}) > 20


def test_documents_and_plan(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    df = QUERIES["op13_license_scan"](spark, SF)
    got = df.collect()
    assert len(got) == len(docs) and "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        labels, score, found = every(docs[r.doc_id])
        assert (r.labels, r.score, r.n_detections) == (labels, score, len(found))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert sum(r.n_base for r in got)


def test_suppression(spark):
    texts = {"GNU General Public License, version 3": "gpl,gpl-3.0", "GNU Lesser General Public License v2.1": "lgpl-2.1", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0,licensed-under", "SPDX-License-Identifier: CC-BY-4.0": "cc-by,cc-by-4.0"}
    for r in scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r.labels == texts[r.text]
