"""Hard-negative mining with matrix products in a residue number system.

Integer vectors are multiplied modulo several small primes: residues between
-255 and 255 in float32, at most 256 dimensions at a time, so that every sum
stays below 2 ** 24 and the product is exact.  As many primes are taken as the
largest possible score needs; the signed score comes back from its residues by
Chinese remaindering (mixed radix digits around zero).

1. Anchors are multiplied with all rows, block by block; each pair of blocks
   gives an anchor's best rows of its own label, and of these the first
   ``positives`` over all blocks are its positives.
2. The anchors, with the scores of their positives, are multiplied with all rows
   again.  A positive's window is the scores from ``low`` to ``high`` hundredths
   of its own; a pair of blocks gives the first ``negatives`` rows of another
   label in each window, and the first of these over all blocks are the result.

Blocks hold thousands of rows whatever their labels, so a label in a third of
all rows makes no group.

Defined cases: rows with a null label or vector, or a component that is null,
NaN or infinite, take no part; a row without id is no anchor and comes last among ties; rows
that repeat an id are rows of their own; vectors of several lengths meet as if the
shorter were filled with zeros; a window is empty where the positive's score is
negative; anchors without positives, or windows without rows, give no rows; further columns are
ignored; empty tables give empty results; components of 2 ** 53 and scores of 2 ** 62 or
more raise.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.vector_blocks import blocks, bound, meet, opened, quantised, same_length

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 8192
LARGEST, DIMENSIONS = 511, 256           # residues of primes up to 511, so many at a time: below 2 ** 24
NONE = np.iinfo(np.int64).max


@lru_cache
def primes(product: int) -> tuple[int, ...]:
    """The largest odd primes up to ``LARGEST`` whose product is over ``product``."""
    out, p, have = [], LARGEST, 1
    while have <= product:
        if p < 3:
            raise ValueError("the scores are too large")
        if all(p % q for q in range(3, int(p ** 0.5) + 1, 2)):
            out.append(p)
            have *= p
        p -= 2
    return tuple(out)


def _around(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    x = x % p
    return np.where(x > p // 2, x - p, x)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices."""
    a, b = same_length(a, b)
    most = bound(a, b)
    if most >= 1 << 62:
        raise ValueError("scores of 2 ** 62 and more don't fit")
    chosen = primes(2 * most + 1)
    digits: list[np.ndarray] = []
    for i, p in enumerate(chosen):
        x, y = (_around(m, p).astype(np.float32) for m in (a, b))
        r = np.zeros((len(a), len(b)), np.int32)
        for d in range(0, a.shape[1], DIMENSIONS):
            r = (r + (x[:, d:d + DIMENSIONS] @ y[:, d:d + DIMENSIONS].T).astype(np.int32)) % p
        for digit, q in zip(digits, chosen):                  # mixed radix: take off a digit, divide by its prime
            r = (r - digit) * pow(q, -1, p) % p
        digits.append(_around(r, p).astype(np.int32))
    out = np.zeros((len(a), len(b)), np.int64)
    for digit, p in zip(reversed(digits), reversed(chosen)):
        out = out * p + digit
    return out


def _best(keep: np.ndarray, s: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of ``keep`` by score (highest first), id and row, the first ``most``."""
    if len(keep) > 4 * most:
        edge = np.partition(s[keep], len(keep) - most)[len(keep) - most]
        keep = keep[s[keep] >= edge]
    return keep[np.lexsort((rows[keep], ids[keep], -s[keep]))][:most]


def _own_label(queries, rows, most: int):
    q, r = opened(queries, ["row", "id", "label", "v"]), opened(rows, ["row", "id", "label", "v"])
    s = scores(q["v"], r["v"])
    out = [[], [], [], []]
    for i in range(len(s)):
        got = _best(np.flatnonzero((r["label"] == q["label"][i]) & (r["row"] != q["row"][i])), s[i], r["id"], r["row"], most)
        for x, y in zip(out, (np.full(len(got), q["row"][i]), r["row"][got], r["id"][got], s[i][got])):
            x.append(y)
    return [np.concatenate(x) for x in out]


def _in_windows(queries, rows, positives: int, most: int, low: int, high: int):
    which = [(f"p_row{k}", f"p_id{k}", f"p_score{k}") for k in range(positives)]
    q = opened(queries, ["row", "id", "label", "v", *[c for w in which for c in w]])
    r = opened(rows, ["row", "id", "label", "v"])
    s = scores(q["v"], r["v"])
    out = [[] for _ in range(8)]
    for i in range(len(s)):
        windows = []
        for w in which:
            p_row, p_id, p_score = (int(q[c][i]) for c in w)
            first, last = -(-low * p_score // 100), high * p_score // 100
            if p_row != NONE and first <= last:
                windows.append((p_row, p_id, p_score, first, last))
        if not windows:
            continue
        keep = np.flatnonzero((r["label"] != q["label"][i]) & (s[i] >= min(w[3] for w in windows))
                              & (s[i] <= max(w[4] for w in windows)))
        keep = keep[np.lexsort((r["row"][keep], r["id"][keep], -s[i][keep]))]
        down = -s[i][keep]
        for p_row, p_id, p_score, first, last in windows:
            at = np.searchsorted(down, -last)
            got = keep[at:at + most]
            got = got[s[i][got] >= first]
            for x, y in zip(out, (np.full(len(got), q["row"][i]), np.full(len(got), q["id"][i]), np.full(len(got), p_row),
                                  np.full(len(got), p_id), r["row"][got], r["id"][got], np.full(len(got), p_score), s[i][got])):
                x.append(y)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
         times: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.  Anchors are the rows where ``is_anchor`` (of ``id``) is
    true; each component x counts as floor(``times`` x)."""
    label = (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")
    all_rows = quantised(rows.where(label.isNotNull()), id_col, vector_col, times, (label,), "negatives-rows")
    store, n_store = blocks(all_rows.select("row", "id", "label", "v"), ROWS_AT_ONCE, "negatives-blocks")
    anchors = all_rows.where(is_anchor).select("row", "id", "label", "v")
    asked, n_asked = blocks(anchors, ANCHORS_AT_ONCE, "negatives-anchors")
    near = meet(asked, n_asked, store, n_store, lambda q, r: _own_label(q, r, positives),
                "row long, p_row long, p_id long, p_score long")
    by = Window.partitionBy("row").orderBy(F.desc("p_score"), "p_id", "p_row")
    near = near.withColumn("k", F.row_number().over(by)).where(F.col("k") <= positives)
    wide = near.groupBy("row").agg(*[F.max(F.when(F.col("k") == k + 1, F.col(c))).alias(f"{c}{k}")
                                     for k in range(positives) for c in ("p_row", "p_id", "p_score")])
    asked, n_asked = blocks(anchors.join(wide, "row"), ANCHORS_AT_ONCE, "negatives-windows")
    got = meet(asked, n_asked, store, n_store, lambda q, r: _in_windows(q, r, positives, negatives, low, high),
               "row long, anchor_id long, p_row long, p_id long, n_row long, n_id long, p_score long, n_score long")
    by = Window.partitionBy("row", "p_row").orderBy(F.desc("n_score"), "n_id", "n_row")

    def id_of(c: str) -> Column:                  # blocks hold a missing id as the largest long
        return F.when(F.col(c) != F.lit(int(NONE)), F.col(c))

    return (got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
            .select("anchor_id", id_of("p_id").alias("positive_id"), "rank", id_of("n_id").alias("negative_id"),
                    F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score")))
