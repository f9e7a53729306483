"""Hard negatives and exact top-k search against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import bit_sliced as B
from tenderlake.llm import hard_negatives as H
from tenderlake.llm import vector_blocks as V

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id string, v int, score int"


def vectors(n=260, dims=7, seed=3, spread=0.4):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, spread)) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]
    rows += [(100 * k, list(rows[5][1]), 0) for k in (7, 8)]                     # equal vectors, also of anchors
    rows += [(i + 3000, list(rows[5][1]), 1 + i % 2) for i in range(40)]
    rows += [(17, list(rows[17][1]), 0), (100, list(rows[100][1]), 0)]           # repeated ids
    rows += [(None, list(rows[3][1]), 2), (900, None, 1), (901, rows[3][1], None), (1000, [float("nan")] * dims, 1),
             (1100, [float("inf")] + [0.0] * (dims - 1), 1), (1200, [None] + [0.0] * (dims - 1), 1), (1300, [], 1),
             (1400, [0.5, -0.25], 1), (1500, [0.0] * dims, 1), (1600, [-0.001] * dims, 2), (1700, rows[9][1] + [3.0], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def whole(rows, times):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(times * x) for x in v], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(i):
    return (i is None, i)


def plain_top(rows, times=64, k=20, every=20):
    rows, out = whole(rows, times), []
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            got = sorted((-dot(v, w), order(j)) for b, (j, w, _) in enumerate(rows) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, (_, j)) in enumerate(got)]
    return sorted(out, key=str)


def plain_negatives(rows, times=256):
    rows = whole([(i, v, None if c is None else (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in rows], times)
    rows = [r for r in rows if r[2] is not None]
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i is None or i % 100:
            continue
        s = [(-dot(v, w), order(j), d) for b, (j, w, d) in enumerate(rows) if b != a]
        for p, j, _ in sorted(x for x in s if x[2] == c)[:5]:
            got = sorted(x for x in s if x[2] != c and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j[1], r + 1, x[1][1], -p, -x[0]) for r, x in enumerate(got)]
    return sorted(out, key=str)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mined(spark, rows):
    got = H.mine(frame(spark, rows).repartition(4), F.col("id") % 100 == 0, label=label())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def top(spark, rows, **kw):
    got = B.top_k(frame(spark, rows).repartition(4), F.col("id") % 20 == 0, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def small_blocks(monkeypatch, m, name):
    monkeypatch.setattr(m, "ROWS_AT_ONCE", 70)
    monkeypatch.setattr(m, name, 3)


def test_negatives(spark, monkeypatch):
    want = plain_negatives(vectors())
    assert len(want) > 50 and mined(spark, vectors()) == want
    small_blocks(monkeypatch, H, "ANCHORS_AT_ONCE")
    assert mined(spark, vectors()) == want


def test_top(spark, monkeypatch):
    want = plain_top(vectors())
    assert len(want) > 200 and top(spark, vectors()) == want
    small_blocks(monkeypatch, B, "QUERIES_AT_ONCE")
    assert top(spark, vectors()) == want


def test_values_with_more_digits_than_slices(spark, monkeypatch):
    rows = vectors(spread=300.0)
    want = plain_top(rows)
    for slices in (1, 4, 12):
        monkeypatch.setattr(B, "SLICES", slices)
        assert top(spark, rows) == want


def test_few_and_no_rows(spark):
    assert mined(spark, []) == [] and top(spark, []) == []
    odd = [(None, None, None), (0, None, 1), (20, [float("nan")], 1)]
    assert mined(spark, odd) == [] and top(spark, odd) == []
    one = [(0, [1.0], 1)]
    assert mined(spark, one) == [] and top(spark, one) == []
    two = [(0, [1.0, 2.0], 1), (20, [0.5, 0.5], 1)]
    assert top(spark, two) == plain_top(two) and mined(spark, two) == []


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        top(spark, [(0, [1e30], 1), (1, [1.0], 1)])


@pytest.mark.parametrize("most,dims", [(3, 5), (300, 64), (40_000, 300), (1 << 26, 700)])
def test_residues(most, dims):
    rng = np.random.default_rng(most)
    a, b = (rng.integers(-most, most + 1, (n, dims)) for n in (9, 21))
    a[0], b[0], b[1] = most, most, -most
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert H.scores(a, b).tolist() == want
    assert all(all(p % q for q in range(2, p)) for p in H.primes(1 << 62))
    # float32 sums of a chunk stay exact
    assert H.DIMENSIONS * (H.LARGEST // 2) ** 2 < 1 << 24


def test_slices_add_up():
    rng = np.random.default_rng(1)
    v = rng.integers(-40, 90, (200, 12))
    have = B.Sliced.of(v)
    ids = rows = np.arange(200)
    for _ in range(30):
        q = rng.integers(-70, 70, 12)
        places, got = have.best(q, 200, np.empty(0, np.int64), ids, rows)
        assert got.tolist() == (v @ q)[places].tolist() and sorted(places.tolist()) == ids.tolist()
    for j in range(12):
        assert have.values(ids, j).tolist() == v[:, j].tolist()


def test_blocks_are_even(spark):
    rows = V.quantised(frame(spark, vectors(1000)), "vec_id", "embedding", 64)
    got, n = V.blocks(rows.select("row", "id", "v"), 100, "test-blocks")
    sizes = [r.n for r in got.collect()]
    assert n == -(-rows.count() // 100) and sum(sizes) == rows.count() and max(sizes) <= 120
