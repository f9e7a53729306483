"""Typed notice fields: parsed once, stored beside the body, read by extraction
and detection."""

import json

from pyspark.sql import functions as F

from tenderlake.operators import state as ST
from tenderlake.operators.extract import extract_notice
from tenderlake.operators.signals import detect_signals
from tenderlake.plans import inputs
from tenderlake.plans.catalog import QUERIES
from tenderlake.sources.notices import explode_feed, normalize_notices, with_notice

SF = "/root/testdata/sf0.001"
NOTICES = [
    {"id": "1", "title": "0", "buyer": "false", "customer": "C", "url": "0", "source_url": "u", "agreement_type": "0"},
    {"id": "2", "title": 0, "buyer": False, "customer": "C", "url": 0, "source_url": "u", "agreement_type": 0,
     "notice_type": "Framework"},
    {"id": "3", "title": "The  DPS of", "agreement_type": [], "description": ""},
    {"id": "4", "title": "frame", "agreement_type": "x", "category": "", "status": " Open ", "published_at": "d"},
    {"id": "5", "title": "framed", "agreement_type": "dynamic\tpurchasing system", "description": "text"},
    {"id": "6", "title": "dynamic purchasing", "notice_type": "system"},
    {"id": "7"},
]


def raw_of(spark):
    feed = spark.createDataFrame([(1, "s", json.dumps(NOTICES))], "seq long, source_name string, payload string")
    return inputs.with_raw_ids(normalize_notices(explode_feed(feed)).withColumn("seq", F.col("pos")))


def test_values_by_type(spark):
    got = {r.raw_id: r for r in extract_notice(raw_of(spark)).collect()}
    assert [(got[i].title, got[i].customer, got[i].source_url, got[i].agreement_type) for i in (0, 1)] == [
        ("0", "false", "0", "0"), ("0", "C", "u", "0")]
    assert got[2].description == json.dumps(NOTICES[2], sort_keys=True, separators=(",", ":")) and got[4].description == "text"
    sig = {r.raw_id: r for r in detect_signals(raw_of(spark)).collect()}
    assert {i for i, r in sig.items() if r.detected} == {1, 2, 3, 4}
    assert [sig[i].agreement_type for i in range(7)] == ["0", "unspecified", "unspecified", "x", "dynamic purchasing system", "unspecified", "unspecified"]
    assert (sig[3].status, sig[3].published_at, sig[3].category) == ("open", "d", "")


def test_stored_without_the_column(spark):
    """Items of a store that has no typed column give the same results."""
    raw = raw_of(spark)
    bare = raw.drop("notice")
    for f in (extract_notice, detect_signals):
        assert sorted(map(str, f(raw).collect())) == sorted(map(str, f(bare).collect()))
    odd = spark.createDataFrame([(1, "procurement", "s", "1", "b", m, "h") for m in (None, "", "{", "[]", "{}", '{"notice_payload": 3}')],
                                "seq long, source_type string, source_name string, external_id string, raw_body string, "
                                "metadata string, content_hash string").withColumn("raw_id", F.monotonically_increasing_id())
    assert extract_notice(odd).where("title is null and description = 'b'").count() == 6
    assert with_notice(odd.withColumn("source_type", F.lit("email"))).where("notice is not null").count() == 0


def test_state_keeps_the_column(spark):
    raw = raw_of(spark).withColumn("received_at", F.lit(None).cast("timestamp"))
    state = ST.upsert_raw(None, raw.where("seq < 4"))
    assert state.where("notice is null").count() == 0
    bare = state.drop("notice", "changed").withColumn("extraction_error", F.lit(None).cast("string")).checkpoint()
    both = ST.upsert_raw(bare, raw.where("seq >= 2"))
    assert {r.external_id: r.notice.title for r in both.collect()} == {
        "1": "0", "2": "0", "3": "The  DPS of", "4": "frame", "5": "framed", "6": "dynamic purchasing", "7": None}


def test_no_filter_reaches_the_parsing(spark):
    for name in ("signal_detect", "signal_list", "gap_upsert"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 200_000 and "variant" not in plan and "from_json" not in plan, (name, len(plan))
    plan = QUERIES["extract_all"](spark, SF).where("title = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
