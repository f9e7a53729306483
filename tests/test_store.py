"""The bucketed store: the same state as without it, and only touched buckets
are written."""

import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tenderlake.plans import store
from tenderlake.plans.pipeline import Delta, PipelineState, run_batch
from tenderlake.sources.notices import explode_feed, normalize_notices

RAW = "seq long, source_type string, source_name string, external_id string, raw_body string, metadata string, received_at timestamp"


def job(title, uri, customer="Oslo kommune", due="2026-06-30"):
    return json.dumps({"job_overview": {"title": title, "company": customer, "description": None, "delivery_date": due, "job_uri": uri},
                       "description": "Python backend", "description_summarised": None, "platform": "Mercell"})


def listings(spark, rows):
    return spark.createDataFrame([(i, "scraper", "Mercell", k, b, "{}", None) for i, (k, b) in enumerate(rows)], RAW)


def notices(spark, items):
    feed = spark.createDataFrame([(1, "doffin", json.dumps(items))], "seq long, source_name string, payload string")
    return normalize_notices(explode_feed(feed)).drop("pos")


def batches(spark):
    first = [(f"k{i}", job(f"Backend {i}", f"https://m.example/{i % 7}", f"Buyer {i % 3}")) for i in range(12)] + [("bad", "no json")]
    deals = [{"id": str(i), "title": f"Frame {i}", "buyer": f"Buyer {i}", "agreement_type": "dps"} for i in range(4)]
    yield listings(spark, first).unionByName(notices(spark, deals), allowMissingColumns=True)
    # one key with new content in a cluster of its own, one that fails now, one signal that is none any more
    yield listings(spark, [("k3", job("Data engineer", "https://m.example/new")), ("k4", "broken"), ("bad", job("Was bad", "https://m.example/1"))]
                   ).unionByName(notices(spark, [{"id": "2", "title": "Open", "buyer": "Buyer 2"}]), allowMissingColumns=True)
    yield listings(spark, [("k9", job("Again", "https://m.example/2", "Buyer 1", "2027-01-01"))])


def values(state):
    return {n: sorted(map(str, df.select(*sorted(c for c in df.columns if c != "changed")).collect()))
            for n, df in state.tables().items() if df is not None}


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/state") for f in names
            if f.endswith(".parquet") and "/_" not in d}


@pytest.fixture(scope="module")
def history(spark):
    root = tempfile.mkdtemp(prefix="tl-buckets-", dir="/tmp")
    plain, out = PipelineState(), []
    for i, batch in enumerate(batches(spark)):
        kw = dict(as_of=f"2026-01-0{i + 1} 00:00:00")
        plain, want = run_batch(spark, plain, batch, i, **kw)
        _, stored = store.read_state(spark, root)
        new, got = run_batch(spark, stored, batch, i, **kw)
        before = files(root)
        store.write_state(spark, i, new, root, buckets=16)
        back = store.read_state(spark, root)[1]
        out.append((values(plain), values(back), want.first(), got.first(), before, files(root)))
        plain = PipelineState(**{n: None if df is None else df.checkpoint() for n, df in plain.tables().items()})
    return root, out


def test_same_state_as_without_a_store(history):
    for plain, back, want, got, *_ in history[1]:
        assert want == got and set(plain) == set(back)
        for name in plain:
            assert plain[name] == back[name], name


def test_only_touched_buckets_are_written(spark, history):
    root, out = history
    *_, before, after = out[2]
    assert all(after[f] == t for f, t in before.items())              # nothing that was there is written again
    new = {f.split("/state/v=2/")[1] for f in set(after) - set(before)}
    buckets = {}
    for f in new:
        buckets.setdefault(f.split("/")[0], set()).add(f.split("/")[1])
    # one item, in a cluster it is detached from and one it joins
    assert len(buckets["raw"]) == len(buckets["records"]) == 1
    assert all(len(buckets.get(t, ())) <= 3 for t in ("links", "clusters", "scores", "primary"))
    assert "signals" not in buckets
    rows = spark.read.parquet(f"{root}/state/v=2/raw").count()
    assert rows < spark.read.schema("raw_id long").parquet(f"{root}/state/v=0/raw").count()


def test_a_batch_reads_the_buckets_of_its_keys(spark, history):
    root, _ = history
    state = store.read_state(spark, root)[1]
    keys = spark.createDataFrame([("scraper", "Mercell", "k3")], "source_type string, source_name string, external_id string")
    near = state.nearby("raw", keys)
    assert near.where("external_id = 'k3'").count() == 1 and near.count() < state.raw.count()
    assert len({f.split("bucket=")[1].split("/")[0] for f in near.inputFiles()}) == 1


def test_parts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    root = tempfile.mkdtemp(prefix="tl-parts-", dir="/tmp")

    def records(i):
        return spark.range(i * 10, i * 10 + 10).select((F.col("id") % 3).alias("raw_id"), F.col("id").alias("record_id"))
    store.write_state(spark, 0, PipelineState(records=records(0)), root, buckets=2)
    for i in range(1, 8):
        stored = store.read_state(spark, root)[1]
        new = records(i)
        full = stored.records.unionByName(new)
        store.write_state(spark, i, PipelineState(records=full, deltas={"records": Delta(new.select("raw_id"), new, append=True)}), root)
        assert sorted(r.record_id for r in store.read_state(spark, root)[1].records.collect()) == list(range(i * 10 + 10))
    tables = store._tables(spark, root, *store.last_commit(spark, root))
    assert all(len(p) <= 3 for p in tables["records"].parts.values()) and tables["records"].buckets == 2


def test_damage_raises(spark, history):
    root = tempfile.mkdtemp(prefix="tl-damage-", dir="/tmp")
    rows = spark.range(3).withColumnRenamed("id", "raw_id")
    store.write_state(spark, 0, PipelineState(raw=rows), root)
    spark.createDataFrame([("raw", "raw_id BIGINT", 64, 5, [7])], store.MANIFEST_SCHEMA).write.mode("overwrite").parquet(
        f"{root}/state/_manifest/v=0")
    with pytest.raises(AnalysisException):
        store.read_state(spark, root)[1].raw.count()
    spark.createDataFrame([(1, ["raw", "links"])], store.COMMIT_SCHEMA).write.mode("append").parquet(f"{root}/state/_committed")
    spark.createDataFrame([("raw", "raw_id BIGINT", 64, 5, [7])], store.MANIFEST_SCHEMA).write.parquet(f"{root}/state/_manifest/v=1")
    with pytest.raises(ValueError):
        store.read_state(spark, root)
    empty = PipelineState(raw=rows.limit(0))
    other = tempfile.mkdtemp(prefix="tl-empty-", dir="/tmp")
    store.write_state(spark, 0, empty, other)
    assert store.read_state(spark, other)[1].raw.count() == 0
