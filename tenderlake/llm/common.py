"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of the contracts: space, tab, line feed, vertical tab, form
# feed, carriage return.  Everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in
    ``spark.checkpoint.dir``.  Only a local session may go without: it gets a
    temporary folder, remembered in the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tenderlake-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again:
    lineage ends there, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_array(text: Column) -> Column:
    """The words of a text; its only empty pieces are before a leading and
    after a trailing space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Working column names that no column of ``df`` has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, {}
    for n in names:
        new = n
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out[n] = new
    return out


def releasing(run):
    """``run``, a function over a task's batches, which gives the memory it
    freed back to the system when the task ends: Python workers live on and
    would keep it beside the executor's heap."""
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:      # not this C library: nothing to give back by hand
            pass
    return task


def add_columns(df: DataFrame, keep: list[str], inputs: list[Column], added: dict[str, tuple], make,
                rows_at_once: int = 512) -> DataFrame:
    """``keep`` of ``df``, passed through as they are, and new columns made in
    Arrow batches: ``make()`` gives, once a task, a function from the lists of
    the inputs' values to the lists (or Arrow arrays) of the new values.
    ``added``: name -> (Spark type, Arrow type)."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    n = len(keep)
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)],
                           *[T.StructField(f"a{i}", t[0]) for i, t in enumerate(added.values())]])
    kinds = [t[1] for t in added.values()]

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                b = batch.slice(at, rows_at_once)
                new = work(*[b.column(n + i).to_pylist() for i in range(b.num_columns - n)])
                new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], names=schema.names)

    got = rows.mapInArrow(releasing(run), schema)
    return got.toDF(*keep, *added)
