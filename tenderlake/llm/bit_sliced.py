"""Exact top-k search by inner product in a bit-sliced index.

A block of rows is indexed by attribute: each dimension, from the block's least
value up, as one bitmap a binary digit.  A query adds the slices of every
dimension, once for each digit of its own component (complemented where that
is negative), with three-to-two adders on whole bitmaps; the sum is again a
set of slices, the scores of all rows of the block.  The best rows are selected from the most
significant slice downward: rows that hold the digit stay while they are enough,
else they are taken and the search goes on among the others.

At most ``SLICES`` digits of a dimension are added; where a block's values have
more, the score is known up to an error, and every row within it of the limit
is kept.  The rows kept (ties at the limit and those within the error) are
resolved exactly from all their digits, then by the smaller id.

Every block of queries meets every block of rows; the best of each block meet in
a ranking by query.  A row is told by its place in the saved table, so a query is never its own candidate.

Defined cases: rows whose vector is null or holds a null, NaN or infinite
component take no part; a row without id is no query and comes last among ties; rows that
repeat an id are rows of their own, each a candidate of the other; vectors of several lengths meet
as if the shorter were filled with zeros; fewer rows than ``k`` are all returned; further
columns are ignored; empty tables give empty results; components of 2 ** 53 and scores of 2 ** 62 or
more raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.vector_blocks import blocks, matrix, meet, opened, quantised

K = 20
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 16384
SLICES = 12                 # digits of a dimension that are added; all are kept
NONE = np.iinfo(np.int64).max
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def ones(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Places of a bitmap's ones."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=n))


class Sliced:
    """The index of a block: ``low`` and number of digits (``bits``) of each
    dimension, and the slices of all dimensions, least significant first."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, slices: np.ndarray, n: int):
        self.low, self.bits, self.n = low, bits, n
        self.words = -(-n // 64)
        self.slices = slices.reshape(-1, self.words)
        self.first = np.cumsum(bits) - bits
        self.rows = bitmaps(np.ones((1, n), bool))[0]
        self.both = np.concatenate([self.slices, ~self.slices & self.rows])      # as they are, then complemented

    @staticmethod
    def of(v: np.ndarray) -> "Sliced":
        low = v.min(axis=0)
        up = v - low
        bits = np.array([int(x).bit_length() for x in up.max(axis=0)], np.int64)
        slices = [bitmaps((up[:, j] >> np.arange(b)[:, None]) & 1 == 1) for j, b in enumerate(bits.tolist()) if b]
        return Sliced(low, bits, np.concatenate(slices) if slices else np.empty((0, -(-len(v) // 64)), np.uint64), len(v))

    def _sum(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum of what is added, and what it may be short of."""
        at: dict[int, list] = {}
        short, most = 0, 0
        shift = len(self.slices)
        for j, x in enumerate(q.tolist()):
            b = int(self.bits[j])
            if not x or not b:
                continue
            drop = max(0, b - SLICES)
            size = abs(x)
            short += size * ((1 << drop) - 1)
            most += size * ((1 << b) - 1)
            base = int(self.first[j]) + (shift if x < 0 else 0)
            for digit in range(size.bit_length()):
                if size >> digit & 1:
                    for s in range(drop, b):
                        at.setdefault(digit + s, []).append(base + s)
        if most >= 1 << 62:
            raise ValueError("scores of 2 ** 62 and more don't fit")
        out, carried, w = [], [], 0
        while w <= max(at, default=-1) or carried:
            x = self.both[at[w]] if w in at else np.empty((0, self.words), np.uint64)
            if carried:
                x = np.concatenate([x, *carried])
            carried = []
            while len(x) > 2:
                k = len(x) // 3
                a, b, c = x[:k], x[k:2 * k], x[2 * k:3 * k]
                odd = a ^ b
                carried.append(a & b | odd & c)
                x = np.concatenate([odd ^ c, x[3 * k:]])
            if len(x) == 2:
                carried.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            w += 1
        return out, short

    def _over(self, slices: list[np.ndarray], limit: int, among: np.ndarray) -> np.ndarray:
        """Rows of ``among`` whose sum is ``limit`` or more."""
        over, same = np.zeros_like(among), among
        for w in range(len(slices) - 1, -1, -1):
            if limit >> w & 1:
                same = same & slices[w]
            else:
                over = over | same & slices[w]
                same = same & ~slices[w]
        return over | same

    def values(self, places: np.ndarray, j: int) -> np.ndarray:
        """A dimension's values of some rows, from all its digits."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        out = np.full(len(places), self.low[j])
        for s in range(int(self.bits[j])):
            out += ((self.slices[int(self.first[j]) + s][word] >> bit) & np.uint64(1)).astype(np.int64) << s
        return out

    def best(self, q: np.ndarray, k: int, without: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the first k rows by score (highest first), id
        and row; ``without`` are places that are no candidates."""
        d = min(len(q), len(self.bits))
        q = q[:d]
        slices, short = self._sum(q)
        among = self.rows.copy()
        for p in without.tolist():
            among[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        limit = 0
        if np.bitwise_count(among).sum() > k:
            taken, same = np.zeros_like(among), among
            for w in range(len(slices) - 1, -1, -1):
                has = same & slices[w]
                if int(np.bitwise_count(taken | has).sum()) >= k:
                    same, limit = has, limit | 1 << w
                else:
                    taken, same = taken | has, same & ~slices[w]
            among = self._over(slices, limit - short, among) if short and limit > short else among if short else taken | same
        places = ones(among, self.n)
        if short:
            got = sum((self.values(places, j) * int(x) for j, x in enumerate(q.tolist()) if x), np.zeros(len(places), np.int64))
        else:
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            got = np.full(len(places), sum(int(x) * int(lo) - (abs(int(x)) * ((1 << int(b)) - 1) if x < 0 else 0)
                                           for x, lo, b in zip(q.tolist(), self.low.tolist(), self.bits.tolist())), np.int64)
            for w, s in enumerate(slices):
                got += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        order = np.lexsort((rows[places], ids[places], -got))[:k]
        return places[order], got[order]


def index(store: DataFrame) -> DataFrame:
    """Blocks with their slices in place of their vectors."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, dims, row, id_, v = (batch.column(c)[i].as_py() for c in range(6))
                s = Sliced.of(np.frombuffer(v, "<i8").reshape(n, dims))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in ((block, pa.int64()), (n, pa.int64()), (dims, pa.int64()),
                     (row, pa.binary()), (id_, pa.binary()), (s.low.astype("<i8").tobytes(), pa.binary()),
                     (s.bits.astype("<i8").tobytes(), pa.binary()), (s.slices.astype("<u8").tobytes(), pa.binary()))],
                    names=["block", "n", "dims", "row", "id", "low", "bits", "slices"])

    return store.select("block", "n", "dims", "row", "id", "v").mapInArrow(
        run, "block long, n long, dims long, row binary, id binary, low binary, bits binary, slices binary")


def _search(queries, rows, k: int):
    q, r = opened(queries, ["row", "id", "v"]), opened(rows, ["row", "id", "low", "bits"])
    have = Sliced(r["low"], r["bits"], np.frombuffer(rows["slices"][0].as_py(), "<u8"), rows["n"][0].as_py())
    order = np.argsort(r["row"], kind="stable")
    out = [[] for _ in range(5)]
    for i in range(len(q["row"])):
        a, b = np.searchsorted(r["row"][order], [q["row"][i], q["row"][i] + 1])
        places, got = have.best(q["v"][i], k, order[a:b], r["id"], r["row"])
        for x, y in zip(out, (np.full(len(got), q["row"][i]), np.full(len(got), q["id"][i]), r["row"][places], r["id"][places], got)):
            x.append(y)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", times: int = 64,
          k: int = K) -> DataFrame:
    """query_id, rank (from 1), the id of the row found, score.  Queries are the
    rows where ``is_query`` (of ``id``) is true, candidates all other rows; each
    component x counts as floor(``times`` x)."""
    all_rows = quantised(rows, id_col, vector_col, times, name="search-rows")
    store, n_store = blocks(all_rows.select("row", "id", "v"), ROWS_AT_ONCE, "search-blocks")
    asked, n_asked = blocks(all_rows.where(is_query).select("row", "id", "v"), QUERIES_AT_ONCE, "search-queries")
    got = meet(asked, n_asked, index(store), n_store, lambda q, r: _search(q, r, k),
               "row long, query_id long, c_row long, c_id long, score long")
    by = Window.partitionBy("row").orderBy(F.desc("score"), "c_id", "c_row")
    return (got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("c_id") != F.lit(int(NONE)), F.col("c_id")).alias(id_col), "score"))
