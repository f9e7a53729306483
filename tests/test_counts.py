"""Comparisons kept as counts that detached links are taken off: the same as
made anew from all links, whatever came and went."""

import json
import tempfile
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tenderlake.operators.cluster import apply_counts, comparisons, diverging, value_counts
from tenderlake.plans import store
from tenderlake.plans.pipeline import PipelineState, run_batch

RAW = "seq long, source_type string, source_name string, external_id string, raw_body string, metadata string, received_at timestamp"
COUNTS = "cluster_id long, field_name string, value string, n long"


def job(title, uri, customer="Oslo", due="2026-06-30"):
    return json.dumps({"job_overview": {"title": title, "company": customer, "description": None, "delivery_date": due, "job_uri": uri},
                       "description": "Python", "description_summarised": None, "platform": "Mercell"})


def batch(spark, rows):
    return spark.createDataFrame([(i, "scraper", "Mercell", k, b, "{}", None) for i, (k, b) in enumerate(rows)], RAW)


def steps(spark):
    u = "https://m.example/"
    yield batch(spark, [(f"k{i}", job(f"T{i % 2}", f"{u}{i % 3}", f"B{i % 4}")) for i in range(9)])
    # k0 and k3 leave the cluster of /0, one to another, one for none
    yield batch(spark, [("k0", job("T5", u + "1")), ("k3", "broken"), ("k9", job("T0", u + "7"))])
    # the same again, one that comes back, and one item twice
    yield batch(spark, [("k9", job("T0", u + "7")), ("k3", job("T3", u + "0")), ("k9", job("", u + "7", "B9")), ("k1", job("T1", u + "1", "B1"))])
    # the last source of a cluster goes; all values of a field become one
    yield batch(spark, [("k9", "broken"), ("k6", job("T3", u + "0", "Oslo")), ("k2", "broken")])
    yield batch(spark, [("k2", job("T2", u + "2")), ("k6", job("T4", u + "0", "", "2027-01-01"))])


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def runs(spark):
    root, out = tempfile.mkdtemp(prefix="tl-counts-", dir="/tmp"), []
    for i, b in enumerate(steps(spark)):
        _, stored = store.read_state(spark, root)
        new, _ = run_batch(spark, stored, b, i)
        store.write_state(spark, i, new, root, buckets=16)
        out.append((stored, b, new))
    return root, out


def test_equal_to_the_whole_recompute_after_every_batch(spark, runs):
    root, out = runs
    sizes = []
    for _, _, new in out:
        assert rows(new.comparisons) == rows(comparisons(new.links, new.records))
        assert rows(new.value_counts) == rows(value_counts(new.links, new.records))
        sizes.append(new.comparisons.count())
    back = store.read_state(spark, root)[1]
    assert rows(back.comparisons) == rows(out[-1][2].comparisons) and rows(back.value_counts) == rows(out[-1][2].value_counts)
    assert len(set(sizes)) > 2                           # fields began and ceased to differ


def test_links_that_stay_are_not_read_again(spark, runs):
    _, out = runs
    stored, b, new = out[4]
    mine = [r.external_id for r in b.select("external_id").distinct().collect()]
    own = stored.raw.where(F.col("external_id").isin(mine)).select("raw_id")
    others = stored.records.join(own, "raw_id", "left_anti").withColumn("broker", F.lit("never read"))
    bad = replace(stored, records=others.unionByName(stored.records.join(own, "raw_id", "left_semi").select(*others.columns)), near=None)
    again, _ = run_batch(spark, bad, b, 4)
    assert rows(again.comparisons) == rows(new.comparisons)
    # a run changes the counts of the clusters whose links came or went, no others
    delta = new.deltas["value_counts"]
    ids = {r.cluster_id for r in delta.touched.collect()}
    assert ids and len(ids) < new.clusters.count()
    assert {r.cluster_id for r in delta.rows.collect()} <= ids


def test_a_state_without_counts_gets_them(spark, runs):
    _, out = runs
    stored, b, new = out[4]
    got, _ = run_batch(spark, replace(stored, value_counts=None), b, 4)
    assert rows(got.value_counts) == rows(new.value_counts) and rows(got.comparisons) == rows(new.comparisons)
    assert "value_counts" not in got.deltas and "comparisons" not in got.deltas


def test_counts_add_up(spark):
    def counts(*got):
        return spark.createDataFrame(list(got), COUNTS)
    a = counts((1, "title", "x", 2), (1, "title", "y", 1), (2, "title", "x", 1))
    left = apply_counts(a, counts((2, "title", "z", 1)), counts((1, "title", "y", 1)))
    assert rows(left) == rows(counts((1, "title", "x", 2), (2, "title", "x", 1), (2, "title", "z", 1)))
    assert rows(diverging(left).select("cluster_id", "value")) == [(2, "x"), (2, "z")]
    assert apply_counts(None, counts()).count() == 0 == diverging(counts()).count()
    with pytest.raises(PySparkException):
        apply_counts(a, counts(), counts((1, "title", "y", 2))).collect()
