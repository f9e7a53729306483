"""Toxicity: a character n-gram linear classifier on naive-Bayes features.

A text's features are its distinct hashed character 5-, 7- and 9-grams
(lower case, white space as one blank).  Each is scaled by its naive-Bayes log-count
ratio between toxic and other labelled texts; a logistic regression on the
scaled features gives the score.  The model keeps the n-grams of at least
three toxic texts with a high ratio, so at scoring time most positions of a
text look up nothing.

The classifier is fitted on a bounded sample of labelled rows (``max_rows``,
chosen by hash of the id, both classes at their natural rate) in one task;
that task returns the model, a table of at most 2**22 weights.  Scoring is a
map over whole texts in slices of 65,536 characters.

Defined cases: a null or empty text has no features and gets the score of the
intercept; without labelled rows of both classes every score is the share of
toxic labels (0.0 without labels); a document labelled more than once is toxic
if one label says so; repeated rows are scored each; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import add_columns, releasing, saved
from tenderlake.llm.fitting import minimise

MAX_ROWS = 8000          # labelled rows a classifier is fitted on
BITS = 22
SLICE = 1 << 16          # characters worked on at a time
MIN_DOCS, MIN_RATIO, RIDGE = 3, 2.5, 0.05
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


# ----------------------------------------------------------- n-gram features

def _clean(text: str | None) -> str:
    return " " + " ".join((text or "").lower().split()) + " "


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 5-, 7- and 9-grams that start at each position; those
    over a line feed (which only separates texts) get bucket 0."""
    a, b, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
    c = codes.astype(np.uint64)
    pair = c[:-1] * a + c[1:]
    h = pair[:-2] * b + pair[2:]
    grams, breaks = [], np.flatnonzero(codes == 10)
    for n, k, tail in ((5, a, c[4:]), (7, b, pair[5:]), (9, a, pair[7:])):
        h = h[:len(tail)] * k + tail
        out = ((h ^ (h >> np.uint64(31))) * b >> shift).view(np.int64)
        if len(breaks):
            bad = (breaks[:, None] - np.arange(n)).ravel()
            out[bad[(bad >= 0) & (bad < len(out))]] = 0
        grams.append(out)
    return grams


def _distinct(text: str, rows: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Sorted distinct ``row << BITS | bucket``; ``rows``: where each row of
    the text starts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < 10:
        codes = np.append(codes, np.full(10 - len(codes), 10, np.uint32))
    found = []
    for out in _buckets(codes):
        at = np.flatnonzero(out if wanted is None else wanted[out])
        found.append((np.searchsorted(rows, at, side="right") - 1 << BITS) | out[at])
    return np.unique(np.concatenate(found))


def _features(texts, wanted: np.ndarray | None = None):
    """Distinct (text index, bucket) arrays, texts in order, among ``wanted``
    buckets.  Short texts share a slice, a long one is worked on in slices
    that overlap by eight characters."""
    held, first, size = [], 0, 0

    def flush():
        both = _distinct("\n".join(held), np.cumsum([0] + [len(t) + 1 for t in held[:-1]]), wanted)
        return (both >> BITS) + first, both & ((1 << BITS) - 1)

    for i, t in enumerate(texts):
        t = _clean(t)
        if held and size + len(t) > SLICE:
            yield flush()
            held, size = [], 0
        if len(t) > SLICE:
            one = np.zeros(1, np.int64)
            parts = [_distinct(t[k:k + SLICE + 8], one, wanted) for k in range(0, len(t), SLICE)]
            both = np.unique(np.concatenate(parts))
            yield np.full(len(both), i), both
            continue
        if not held:
            first = i
        held.append(t)
        size += len(t) + 1
    if held:
        yield flush()


def _scores(texts, table: np.ndarray, wanted: np.ndarray, start: float) -> np.ndarray:
    out = np.full(len(texts), start)
    for row, bucket in _features(texts, wanted):
        if len(row):
            got = np.bincount(row - row[0], weights=table[bucket])
            out[row[0]:row[0] + len(got)] += got
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


# ------------------------------------------------------------------- fitting

def fit_rows(texts, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights (ratio times coefficient) and the intercept."""
    y = np.asarray(y, dtype=np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    none = np.empty(0, np.int64), np.empty(0)
    if rate in (0.0, 1.0):
        return *none, 30.0 if rate else -30.0
    size = 1 << BITS
    pos, neg = np.zeros(size), np.zeros(size)
    for row, bucket in _features(texts):
        hit = y[row] > 0
        np.add.at(pos, bucket[hit], 1.0)
        np.add.at(neg, bucket[~hit], 1.0)
    # document counts as shares of the class, with one document of prior shared out at the classes' rate
    ratio = np.log((pos + rate) / y.sum()) - np.log((neg + 1 - rate) / (1 - y).sum())
    keep = (pos >= MIN_DOCS) & (ratio >= MIN_RATIO)
    keep[0] = False
    ids = np.flatnonzero(keep)
    found = list(_features(texts, keep))
    row = np.concatenate([x[0] for x in found])
    col = np.searchsorted(ids, np.concatenate([x[1] for x in found]))
    value, n, r = ratio[ids][col], len(y), ratio[ids]

    def loss(w):
        s = np.bincount(row, weights=value * w[col], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
        g = p - y
        out = np.empty_like(w)
        out[:-1] = np.bincount(col, weights=value * g[row], minlength=len(ids)) + ridge * w[:-1]
        out[-1] = g.sum()
        return np.logaddexp(0, s).sum() - (y * s).sum() + ridge / 2 * w[:-1].dot(w[:-1]), out

    w = minimise(loss, np.append(np.zeros(len(ids)), np.log(rate / (1 - rate))))
    return ids, w[:-1] * r, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 11) -> dict:
    """Fit on at most ``max_rows`` labelled documents, chosen by hash.
    ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    one = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    pick = one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    rows = (docs.select("doc_id", "text").join(F.broadcast(saved(pick, "toxicity-sample")), "doc_id")
            .groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"),
                                   F.max("toxic").alias("toxic")))

    def task(batches):
        got = pd.concat([b for b in batches], ignore_index=True) if batches else None
        if got is None or not len(got):
            return
        got = got.sort_values("doc_id")
        ids, w, b = fit_rows(list(got["text"]), got["toxic"].to_numpy())
        yield pd.DataFrame({"ids": [ids.astype(np.int32).tobytes()], "w": [w.astype(np.float32).tobytes()], "b": [b]})

    def gather(batches):
        yield from task(list(batches))

    model = rows.repartition(1).mapInPandas(releasing(gather), "ids binary, w binary, b double").collect()
    if not model:
        return {"ids": b"", "w": b"", "b": -30.0}
    return {"ids": bytes(model[0]["ids"]), "w": bytes(model[0]["w"]), "b": model[0]["b"]}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          into: str = "score") -> DataFrame:
    """``keep`` and the score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)   # at most 2**22 weights

    def make():
        m = sent.value
        ids, weights = np.frombuffer(m["ids"], np.int32), np.frombuffer(m["w"], np.float32)
        table, wanted = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
        table[ids], wanted[ids] = weights, True
        return lambda texts: [_scores(texts, table, wanted, m["b"])]

    return add_columns(docs, list(keep), [F.col(f"`{text_col}`")], {into: (T.DoubleType(), pa.float64())}, make)
