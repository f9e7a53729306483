"""Inputs are dealt out before texts are made of them, state is stored once,
touched clusters need no scores (round 3)."""

from pyspark.sql import functions as F

from test_round3 import _tables


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_staged_rows_are_dealt_out_before_their_texts(spark):
    from tenderlake.plans import staging
    d = _tables(spark, 300)
    for df in (staging.stg_listing(spark, d), staging.stg_notice(spark, d)):
        assert "RepartitionByExpression" in _plan(df)
    assert staging.stg_listing(spark, d).count() == 300 and staging.stg_notice(spark, d).count() == 600


def test_scenario_is_stored_by_columns(spark):
    from tenderlake.plans import inputs
    sc = inputs.cluster_scenario(spark, _tables(spark, 300))
    for df in (sc.old_records, sc.state_clusters, sc.state_links, sc.result.clusters, sc.result.links):
        assert "LogicalRDD" not in _plan(df)
    read = sc.old_records.select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in read and "description" not in read


def test_touched_clusters_need_no_scores(spark):
    from tenderlake.operators.cluster import cluster_records
    names = "record_id long, raw_id long, title string, customer string, deadline string, source_url string"
    old = spark.createDataFrame([(1, 1, "a", "x", "d1", None), (2, 2, "b", "x", "d1", "u/"), (3, 3, None, None, None, None)], names)
    state = cluster_records(old)
    state.clusters, state.links = state.clusters.checkpoint(), state.links.checkpoint()
    new = spark.createDataFrame([(11, 1, "a2", "x", "d1", None), (12, 12, "b", "y", None, "U"), (13, 13, "", None, None, ""),
                                 (14, 13, "n", None, None, None)], names)
    res = cluster_records(new, state.clusters, state.links, old)
    got = {r["cluster_id"] for r in res.touched.collect()}
    scored = {r["cluster_id"] for r in res.new_links.select("cluster_id").collect()}
    assert got == scored | {r["cluster_id"] for r in res.detached.collect()} == {1, 2, 3, 11, 14}
    assert "_dl_first" not in _plan(res.touched) and "_heavy" not in _plan(res.touched)


def test_normalized_text_leaves_single_spaces_alone(spark):
    from tenderlake.functions.text import normalize_text, normalize_url
    texts = ["a b", " A  b ", "\ta b\n", "a  b\u0085", "  ", "", None, "a \t b c", "　x\x0b", "x/ /", "//", "a//b//", " /A/ "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", normalize_text("t").alias("n"), normalize_url("t").alias("u")).collect()
    for r in got:
        want = " ".join((texts[r["i"]] or "").lower().split())
        assert r["n"] == want and r["u"] == want.rstrip("/")
    plan = _plan(spark.range(1).select(normalize_text(F.col("id").cast("string")).alias("n")))
    assert plan.count("regexp_replace") == 1


def test_a_search_scores_the_links_of_what_it_found(spark):
    from tenderlake.operators.cluster import memberships
    from tenderlake.operators.policy import FilterPolicy
    from tenderlake.plans.views import cluster_view
    names = "record_id long, title string, customer string, deadline string, source_url string"
    recs = spark.createDataFrame([(1, "python api", "Oslo", "d", None), (2, "python api", "Oslo", "d", None), (3, "java", "Bergen", "d", None),
                                  (4, "x", None, None, "https://oslo.example/1")], names)
    recs = recs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("summary", "description", "broker")])
    clusters, links = (x.checkpoint() for x in memberships(recs))
    every = cluster_view(clusters, links, recs, FilterPolicy.build())
    found = cluster_view(clusters, links, recs, FilterPolicy.build(), q="oslo")
    assert found.sort("cluster_id").collect() == every.where("cluster_id in (1, 4)").sort("cluster_id").collect()
    assert [r["source_count"] for r in found.sort("cluster_id").collect()] == [2, 1]
    assert "LeftSemi" in _plan(found)
