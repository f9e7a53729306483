"""Records that hold their cluster keys, and the comparisons of the review queue."""

from tenderlake.operators.cluster import KEYED_COLS, cluster_key, cluster_records, comparisons, with_cluster_key
from tenderlake.plans.views import needs_review, review_queue

SCHEMA = "record_id long, raw_id long, title string, customer string, broker string, deadline string, source_url string"
ROWS = [(1, 1, "A  b", "x", "m", "1997-01-01", "https://Q.no/1/"), (2, 2, "a b", "X ", "n", "1997-01-01", "https://q.no/1"),
        (3, 3, "a b", "x", "m", " 1997-01-01", None), (4, 4, "A b", "x", "n", "1997-01-01", ""), (5, 5, None, None, None, None, "/"),
        (6, 6, "", None, "m", None, None), (7, 7, "c", "y", "m", None, None)]


def test_keys_are_made_once(spark):
    recs = spark.createDataFrame(ROWS, SCHEMA)
    keyed = with_cluster_key(recs)
    want = recs.select("record_id", cluster_key("title", "customer", "deadline", "source_url").alias("k"))
    assert {r.record_id: r.cluster_key for r in keyed.collect()} == {r.record_id: r.k for r in want.collect()}
    assert set(KEYED_COLS) <= set(keyed.columns) and with_cluster_key(keyed) is keyed
    plain, again = cluster_records(recs), cluster_records(spark.createDataFrame(keyed.collect(), keyed.schema))
    for a, b in ((plain.clusters, again.clusters), (plain.links, again.links), (plain.touched, again.touched)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    # of a stored key nothing is normalized again but the compared titles and customers
    assert "source_url" not in again.links._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_only_the_queue_is_compared(spark):
    recs = spark.createDataFrame(ROWS, SCHEMA)
    res = cluster_records(recs)
    every = review_queue(res.clusters, comparisons(res.links, recs))
    some = comparisons(res.links, recs, needs_review(res.clusters))
    queue = review_queue(res.clusters, some)
    assert sorted(map(str, every.collect())) == sorted(map(str, queue.collect()))
    status = {r.cluster_id: r.review_status for r in res.clusters.collect()}
    assert {status[r.cluster_id] for r in some.collect()} == {"needs_review"} < set(status.values())
