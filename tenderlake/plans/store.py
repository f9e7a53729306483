"""Stored state in key buckets, without MERGE.

Layout under a root that the caller names (a folder all executors share and
that outlives the session):

* ``state/v=<batch_id>/<table>/bucket=<b>/`` Parquet: the buckets of a table that
  the batch rewrote (rows are dealt by a hash of the table's key);
* ``state/_manifest/v=<batch_id>/``: for every table its schema and, for every
  bucket, the batches whose files hold it;
* ``state/_committed``: one row per committed batch, its id and its tables.

A run reads what the newest manifest names.  Of a table it writes only the buckets
in which the batch changes rows; tables that only grow get the new rows alone, and a bucket
of many parts is written as one again.  The commit row comes last,
so a crash or lost executor leaves the previous version
intact, and replaying a committed batch id is skipped.  What a commit
names must be readable: damage raises, it never reads as an empty state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.operators.signals import SIGNAL_KEY
from tenderlake.operators.state import KEY
from tenderlake.plans.pipeline import Delta, PipelineState

COMMIT_SCHEMA = "batch_id bigint, tables array<string>"
MANIFEST_SCHEMA = "name string, columns string, buckets int, bucket int, parts array<bigint>"
BUCKETS = 64                 # of a table when it is first written; more for larger states
MOST_PARTS = 8               # parts of a bucket that are read side by side
BUCKET_KEYS = {"raw": KEY, "records": ["raw_id"], "signals": SIGNAL_KEY, "gaps": ["gap_key"], "evidence": ["gap_key"]}
CLUSTER_KEY = ["cluster_id"]


def _state(root: str) -> str:
    if not root:
        raise ValueError("the state store needs a root folder of its own")
    return root.rstrip("/") + "/state"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """The commit rows; none before the first commit."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(_state(root) + "/_committed")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def is_committed(spark: SparkSession, batch_id: int, root: str) -> bool:
    return not _commits(spark, root).where(F.col("batch_id") == int(batch_id)).isEmpty()


def last_commit(spark: SparkSession, root: str) -> tuple[int, list[str]] | None:
    """(batch id, tables) of the newest version."""
    r = _commits(spark, root).agg(F.max(F.struct("batch_id", "tables")).alias("c")).first()
    return None if r.c is None else (r.c.batch_id, list(r.c.tables))


class Table:
    """A stored table: its columns, number of buckets and the parts of each
    bucket (a manifest has a row for each bucket, whatever the tables hold)."""

    def __init__(self, spark: SparkSession, root: str, name: str, columns: T.StructType, buckets: int,
                 parts: dict[int, list[int]]):
        self.spark, self.root, self.name = spark, root, name
        self.columns, self.buckets, self.parts = columns, buckets, parts

    def path(self, part: int) -> str:
        return f"{_state(self.root)}/v={part}/{self.name}"

    def key(self) -> list[str]:
        return _key(self.name, self.columns.names)

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of all or some buckets."""
        places = [f"{self.path(p)}/bucket={b}" for b, parts in sorted(self.parts.items())
                  if buckets is None or b in buckets for p in parts]
        if not places:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*places)

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return {r.b for r in keys.select(_bucket(self.key(), self.buckets).alias("b")).distinct().collect()}


def _key(name: str, columns: list[str]) -> list[str]:
    return [k for k in BUCKET_KEYS.get(name, CLUSTER_KEY) if k in columns] or columns[:1]


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _tables(spark: SparkSession, root: str, version: int, names: list[str]) -> dict[str, Table]:
    """The tables that a version's manifest names."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{_state(root)}/_manifest/v={version}").collect()
    out: dict[str, Table] = {}
    for r in rows:
        t = out.setdefault(r.name, Table(spark, root, r.name, T.StructType.fromDDL(r["columns"]), r.buckets, {}))
        if r.bucket is not None:
            t.parts[r.bucket] = list(r.parts)
    if set(out) != set(names):
        raise ValueError(f"the manifest of version {version} does not hold the tables of its commit")
    return out


def read_state(spark: SparkSession, root: str) -> tuple[int | None, PipelineState]:
    last = last_commit(spark, root)
    if last is None:
        return None, PipelineState()
    tables = _tables(spark, root, *last)
    state = PipelineState(**{n: t.read() for n, t in tables.items()})
    state.near = lambda name, keys: tables[name].read(tables[name].buckets_of(keys))
    return last[0], state


def _write(df: DataFrame, table: Table, batch_id: int) -> set[int]:
    """Write rows as the batch's part; gives the buckets that have rows."""
    path = table.path(batch_id)
    rows = df.select(*table.columns.names, _bucket(table.key(), table.buckets).alias("bucket"))
    # a bucket's rows come together; large buckets are split into several files
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    found = table.spark.read.schema(T.StructType([*table.columns, T.StructField("bucket", T.IntegerType())])).parquet(path)
    return {r.bucket for r in found.select("bucket").distinct().collect()}


def _write_delta(table: Table, delta: Delta, batch_id: int) -> None:
    touched = table.buckets_of(delta.touched)
    many = {b for b in touched if len(table.parts.get(b, [])) >= MOST_PARTS}
    rows = delta.rows
    names = table.columns.names
    if delta.append:
        if many:
            rows = rows.select(*names).unionByName(table.read(many))
        has = _write(rows, table, batch_id) if touched else set()
        for b in has:
            table.parts[b] = [batch_id] if b in many else table.parts.get(b, []) + [batch_id]
        return
    if not touched:
        return
    keys = delta.touched.select(*delta.touched.columns).distinct()
    kept = table.read(touched).join(keys, keys.columns, "left_anti")
    has = _write(kept.select(*names).unionByName(rows.select(*names)), table, batch_id)
    for b in touched:
        table.parts.pop(b, None)
        if b in has:
            table.parts[b] = [batch_id]


def write_state(spark: SparkSession, batch_id: int, state: PipelineState, root: str, buckets: int = BUCKETS) -> None:
    """Write what the batch changes (a table without :class:`Delta` or stored
    version whole), then the manifest, then the commit row.  A table that has got
    a column since it was stored is written whole once."""
    batch_id = int(batch_id)
    last = last_commit(spark, root)
    stored = {} if last is None else _tables(spark, root, *last)
    tables = {}
    for name, df in state.tables().items():
        if df is None:
            continue
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        table, delta = stored.get(name), state.deltas.get(name)
        if table is not None and delta is not None and set(schema.names) == set(table.columns.names):
            _write_delta(table, delta, batch_id)
        else:
            table = Table(spark, root, name, schema, table.buckets if table else buckets, {})
            table.parts = {b: [batch_id] for b in _write(df, table, batch_id)}
        tables[name] = table
    rows = [(n, t.columns.toDDL(), t.buckets, b, parts) for n, t in tables.items()
            for b, parts in (sorted(t.parts.items()) or [(None, None)])]
    (spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
     .write.mode("overwrite").parquet(f"{_state(root)}/_manifest/v={batch_id}"))
    (spark.createDataFrame([(batch_id, list(tables))], COMMIT_SCHEMA).coalesce(1)
     .write.mode("append").parquet(_state(root) + "/_committed"))
