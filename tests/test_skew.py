"""Clusters that hold most of the rows: same results, and no join sends their
rows to one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import skew
from tenderlake.operators.cluster import cluster_records, comparisons, memberships, refresh_primary, with_cluster_key

SCHEMA = ("record_id long, raw_id long, title string, customer string, broker string, deadline string, source_url string, "
          "source_type string, source_kind string, platform string, host string, extraction_confidence double")
N = 1000


def records(first, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        if rng.random() < 0.7:                       # the all-empty key
            title = customer = deadline = rng.choice([None, "", " "])
            url = None
        elif rng.random() < 0.5:                     # one page with many deadlines
            title, customer, deadline, url = rng.choice(["A", "b", None]), "c", rng.choice(["1", "2", None]), "http://x/"
        else:
            title, customer, deadline, url = f"t{rng.randint(0, 9)}", rng.choice(["c", None]), rng.choice(["1", None]), None
        out.append((i, i % (N // 2), title, customer, rng.choice(["p", "q", None]), deadline, url, "email", None, None, None, 0.5))
    return out


def everything(spark):
    old, new = (spark.createDataFrame(records(*a), SCHEMA) for a in ((0, N, 1), (N, N, 2)))
    stored = cluster_records(old)
    got = cluster_records(new, stored.clusters.checkpoint(), stored.links.checkpoint(), old)
    got.clusters, got.links, got.touched = got.clusters.checkpoint(), got.links.checkpoint(), got.touched.checkpoint()
    both = old.unionByName(new)
    comp = comparisons(got.links, both, got.touched)
    primary = refresh_primary(None, got.clusters, got.links, both, got.touched)
    return {"clusters": got.clusters, "links": got.links, "touched": got.touched, "comparisons": comp, "primary": primary,
            "members": memberships(old)[1]}


def rows(frames):
    return {k: sorted(map(str, df.select(*sorted(df.columns)).collect())) for k, df in frames.items()}


@pytest.fixture(scope="module")
def as_one(spark):
    return rows(everything(spark))


def test_same_results(spark, as_one, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_AT_ONCE", 50)
    assert rows(everything(spark)) == as_one
    monkeypatch.setattr(skew, "MOST_KEYS", 1)
    old = spark.createDataFrame(records(0, N, 1), SCHEMA)
    assert rows({"members": memberships(old)[1]})["members"] == as_one["members"]


def test_every_join_on_a_cluster_is_dealt(spark, monkeypatch):
    """Joins on cluster_key or cluster_id either have the part among their keys
    or have one row a key on both sides."""
    monkeypatch.setattr(skew, "ROWS_AT_ONCE", 50)
    got = everything(spark)
    for name in ("members", "comparisons", "primary"):
        plan = got[name]._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in re.findall(r"Join (?:Inner|LeftOuter|LeftSemi|LeftAnti), \((.*)\)", plan)
                 if re.search(r"cluster_(key|id)#", x) and "_heavy" not in x]
        assert joins and any("_part" in x for x in joins)
    old = spark.createDataFrame(records(0, N, 1), SCHEMA)
    keyed = with_cluster_key(old)
    heavy = skew.HeavyKeys.of(keyed, "cluster_key")
    most = heavy.dealt(keyed, "record_id").groupBy("cluster_key", skew.PART).count().agg(F.max("count")).first()[0]
    assert keyed.where("cluster_key = '||'").count() > 0.6 * N and most < 2 * skew.ROWS_AT_ONCE


def test_records_never_meet_a_key_whole(spark, monkeypatch):
    """In the scores, each join of records has the part among its keys."""
    monkeypatch.setattr(skew, "ROWS_AT_ONCE", 50)
    old = spark.createDataFrame(records(0, N, 1), SCHEMA)
    plan = cluster_records(old).links._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "cluster_key#" in x and "_heavy" not in x]
    assert len(joins) == 2 and all("_part" in x for x in joins)


def test_no_heavy_key(spark):
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    big = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "k long, i long")
    for how, want in (("inner", {10, 11}), ("left", {10, 11, 12, 13}), ("left_semi", {10, 11}), ("left_anti", {12, 13})):
        assert {r.i for r in skew.spread_join(big, small, "k", "i", how).collect()} == want
