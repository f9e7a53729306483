"""Integer vectors in blocks: a query set against all rows, a block of queries
and a block of rows at a time.

Rows are numbered once (in a saved table) and dealt evenly into blocks of at
most some thousand rows, whatever their ids, labels or values; a block is one
packed row.  ``meet`` brings every block of queries together with every block
of rows, and no task holds more than one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import saved

MOST = 1 << 53          # integers up to here are exact in a double


def quantised(rows: DataFrame, id_col: str, vector_col: str, times: int, carry: tuple = (), name: str = "vectors") -> DataFrame:
    """row, id, ``carry``, v: floor(times x) of each component x, as long, for
    every row whose vector is neither null nor holds a null or a component that
    isn't finite; ``row`` numbers the rows.  A component of 2 ** 53 / times or
    more can't be told exactly and raises."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    def whole(c):
        y = c.cast("double") * F.lit(float(times))
        return F.when(F.abs(y) < F.lit(float(MOST)), F.floor(y)).otherwise(
            F.raise_error(F.lit("a component is too large to be multiplied exactly")).cast("long"))

    v = F.transform(x, whole)
    return saved(rows.where(F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), *carry, v.alias("v")), name)


def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """block, n, then a packed column (int64) for each column of ``rows``, and
    the number of blocks.  Vectors (``v``) shorter than the block's longest are
    filled with zeros; ``dims`` is their length.  A null is the largest long."""
    count = -(-rows.count() // size)
    if not count:
        count = 1
    cols = rows.columns

    def pack(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        out, dims = [], 0
        for c in cols:
            col = t.column(c).combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks)
            if c == "v":
                x, dims = matrix(col)
            else:
                x = col.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
            out.append(np.ascontiguousarray(x, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([t.num_rows], pa.int64()), pa.array([dims], pa.int64()),
             *[pa.array([x], pa.binary()) for x in out]], names=["block", "n", "dims", *cols])

    schema = "block long, n long, dims long, " + ", ".join(f"`{c}` binary" for c in cols)
    return saved(rows.repartition(count).mapInArrow(pack, schema), name), count


def matrix(lists) -> tuple[np.ndarray, int]:
    """Vectors as rows, filled with zeros, and their length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out, dims


def opened(table: pa.Table, cols: list[str]) -> dict[str, np.ndarray]:
    """The columns of one packed block."""
    n, dims = table["n"][0].as_py(), table["dims"][0].as_py()
    out = {}
    for c in cols:
        x = np.frombuffer(table[c][0].as_py(), "<i8")
        out[c] = x.reshape(n, dims) if c == "v" else x
    return out


def same_length(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with the columns that both have: what only one has meets zeros."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of a row of ``a`` and one of ``b`` is larger in size."""
    if not a.size or not b.size:
        return 0
    return sum(int(x) * int(y) for x, y in zip(np.abs(a).max(axis=0), np.abs(b).max(axis=0)))


def meet(queries: DataFrame, n_queries: int, rows: DataFrame, n_rows: int, work, schema: str) -> DataFrame:
    """``work(queries, rows)`` of every block of queries and every block of
    rows (both Arrow tables of one packed row), as a DataFrame."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(key, left, right):
        got = work(left, right) if left.num_rows and right.num_rows else [[]] * len(names)
        return pa.table([pa.array(x, k) for x, k in zip(got, types)], names=names)

    def to_each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = queries.withColumnRenamed("block", "qb").withColumn("rb", to_each(n_rows))
    right = rows.withColumnRenamed("block", "rb").withColumn("qb", to_each(n_queries))
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, schema)
