import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.llm.hard_negatives import hard_negatives, packed, products, unpacked
from bidlens.llm.queries import ORACLE_SQL, QUERIES

from .oracle import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor=lambda i: i % 50 == 0, positives=5, negatives=3):
    """Row by row, with whole lists of an anchor; of rows with one id that of the least label and vector."""
    ok = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in ok or (label, v) < ok[i]:
            ok[i] = label, v
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in ok.items()}
    out = []
    for a, (label, v) in whole.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in whole.items() if i != a)
        for s, p, same in [x for x in scored if x[2]][:positives]:
            fitting = [(i, -t) for t, i, also in scored if not also and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, n, i, -s, t) for n, (i, t) in enumerate(fitting[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("KEY", F.lit(1)).withColumn("v", F.lit(0))
    return sorted(tuple(r) for r in hard_negatives(df.repartition(3), F.col("id") % 50 == 0, **how).collect())


def test_sql(spark):
    assert compare(spark, "op11_hard_negatives", QUERIES["op11_hard_negatives"], ORACLE_SQL["op11_hard_negatives"], SF)


def test_keys_sort_as_their_parts():
    rows = [(a, s, k, i) for a in (-(2**63), -1, 0, 2**63 - 1) for s in (2**56, 1, 0, -7) for k in (0, 1) for i in (-5, 0, 9)]
    random.Random(1).shuffle(rows)
    keyed = sorted((packed(np.array([a]), np.array([s]), k, np.array([i]))[0], (a, s, k, i)) for a, s, k, i in rows)
    assert [x for _, x in keyed] == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))
    assert list(zip(*(c.tolist() for c in unpacked([k for k, _ in keyed])))) == [x for _, x in keyed]


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_like_brute_force(spark, seed):
    """Many blocks of either side; few different values, so that scores tie; a hot label and a hot vector."""
    r = random.Random(seed)
    rows = [(i, 0 if r.random() < 0.4 else r.randrange(4), [r.choice([-0.5, 0.0, 0.25, 0.26, 0.3, 1.0]) for _ in range(4)]) for i in range(0, 1500, 5)]
    rows = [(i, label, [0.3, 0.3, 0.25, 1.0] if i % 3 == 0 else v) for i, label, v in rows]
    assert mined(spark, rows, query_rows=7, item_rows=40) == brute(rows)
    assert mined(spark, rows) == brute(rows)
    assert brute(rows)


def test_edges(spark):
    """Rows that take no part, windows at and below zero, ids that repeat, vectors of other lengths, large numbers."""
    rows = [
        (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.4, 0.2]), (3, 2, [0.4, 0.2]), (4, 2, [0.3, 0.3]), (5, 2, [0.3]), (6, 2, []),
        (7, None, [0.4, 0.2]), (None, 2, [0.4, 0.2]), (8, 2, None), (9, 2, [0.4, None]), (10, 2, [0.4, float("nan")]), (11, 2, [float("inf"), 0.1]),
        (2, 2, [0.4, 0.2]), (3, 1, [0.9, 0.9]), (50, 3, [0.0, 0.0]), (51, 3, [0.1, 0.0]), (-50, 4, [-0.5, -0.5]), (12, 4, [0.5, 0.5]), (100, 9, [1.0, 1.0]),
    ]
    assert mined(spark, rows) == brute(rows)
    zero = [r for r in brute(rows) if r[0] == 50]
    assert zero and all(r[4] == r[5] == 0 for r in zero)  # a positive of score 0 takes negatives of score 0, also of smaller ids
    assert mined(spark, []) == mined(spark, [(50, 1, [0.5])]) == []
    big = [(0, 1, [3e8, 1.0]), (1, 1, [3e8, 2.0]), (2, 2, [2e8, 1.0])]
    assert [r[:4] for r in mined(spark, big)] == []  # both scores count as 2 ** 56
    a = np.array([[2.0**40, 1.0]])
    assert products(a, a)[0, 0] == 2**56 and products(np.array([[2.0**27, 1.0]]), np.array([[2.0**26, 3.0]]))[0, 0] == 2**53 + 3
