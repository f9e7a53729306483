"""Identity, stored state and corrected values."""

import json
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tenderlake.functions.text import format_2dp
from tenderlake.operators import state as ST
from tenderlake.operators.analytics import apply_review
from tenderlake.operators.digest import mark_sent
from tenderlake.operators.gaps import set_gap_status
from tenderlake.plans import store
from tenderlake.plans.pipeline import PipelineState, number_batch, run_batch
from tenderlake.session import checkpoint_root
from tenderlake.sources.mail import _read_message, read_landed_mail
from tenderlake.sources.notices import explode_feed, feed_precedence, normalize_notices
from tenderlake.sources.pages import last_line
from tenderlake.streaming.ingest import RAW_ITEM_SCHEMA, start

RAW = "seq long, source_type string, source_name string, external_id string, raw_body string, metadata string, received_at timestamp"


def raw(spark, rows):
    return spark.createDataFrame([(s, t, n, e, b, "{}", None) for s, t, n, e, b in rows], RAW)


def job(title, uri, customer="Oslo kommune"):
    return json.dumps({"job_overview": {"title": title, "company": customer, "description": None,
                                        "delivery_date": "2026-06-30", "job_uri": uri},
                       "description": "Python backend", "description_summarised": None, "platform": "Mercell"})


def feeds(spark, *documents):
    return normalize_notices(explode_feed(spark.createDataFrame(list(documents), "seq long, source_name string, payload string")))


def test_equal_seq_keeps_the_key(spark):
    out = ST.upsert_raw(None, raw(spark, [(1, "s", "m", "a", "x"), (1, "s", "m", "a", "y"), (1, "s", "m", "b", "x")])).collect()
    assert sorted(r.external_id for r in out) == ["a", "b"]
    state = ST.upsert_raw(None, raw(spark, [(1, "s", "m", "a", "x"), (2, "s", "m", "c", "z")])).drop("changed")
    out = {r.external_id: r for r in ST.upsert_raw(state, raw(spark, [(1, "s", "m", "a", "x"), (1, "s", "m", "a", "y")])).collect()}
    assert set(out) == {"a", "c"} and not out["c"].changed and out["a"].raw_id == 1


def test_notices_of_one_document_are_items_of_their_own(spark):
    doc = json.dumps([{"id": i, "title": f"Backend {i}", "buyer": f"Buyer {i}", "url": f"https://t.example/{i}"} for i in "abc"])
    batch = feeds(spark, (1, "doffin", doc)).unionByName(raw(spark, [(1, "scraper", "Mercell", "u", job("Data", "https://m.example/u"))]),
                                                         allowMissingColumns=True)
    state, summary = run_batch(spark, PipelineState(), batch, 0)
    assert state.raw.select("raw_id").distinct().count() == 4
    recs = {r.title: r for r in state.records.collect()}
    assert len({r.record_id for r in recs.values()}) == 4 and recs["Backend b"].customer == "Buyer b"
    assert state.clusters.count() == 4 and summary.first().records == 4
    # sequence numbers that start again in the next batch are new items
    doc2 = json.dumps([{"id": "d", "title": "DPS cloud", "buyer": "Buyer d", "agreement_type": "dps"}])
    state2, _ = run_batch(spark, state, feeds(spark, (1, "doffin", doc2)), 1)
    assert state2.raw.select("raw_id").distinct().count() == 5
    assert state2.records.select("record_id").distinct().count() == 5
    assert [(r.external_id, r.buyer_name) for r in state2.signals.collect()] == [("d", "Buyer d")]


def test_a_batch_counts_its_items_and_numbers_them(spark):
    rows = [(1, "scraper", "Mercell", "a", job("A", "https://m.example/a")), (2, "scraper", "Mercell", "a", job("A2", "https://m.example/a")),
            (3, "scraper", "Mercell", "b", job("B", "https://m.example/b")), (4, "scraper", "Mercell", "c", "not json")]
    state, summary = run_batch(spark, PipelineState(), raw(spark, rows), 3)
    s = summary.first()
    assert (s.raw_items, s.records) == (4, 3)
    assert sorted(r.title for r in state.records.collect()) == ["A2", "B"]
    n = [r.seq for r in number_batch(raw(spark, rows * 2), 2).collect()]
    assert sorted(n) == list(range(2 << 40, (2 << 40) + 8))


def test_run_keeps_comparisons_primary_scores_evidence_and_payloads(spark):
    mail_meta = json.dumps({"subject": "Oppdrag: Other title", "from": "x@y.no"})
    rows = spark.createDataFrame([
        (1, "scraper", "Mercell", "a", job("Data Engineer", "https://m.example/1", "Bergen"), "{}", None),
        (2, "email", "box", "m1", "Se https://m.example/1\nFrist: 2026-06-30", mail_meta, None),
        (3, "scraper", "Mercell", "b", job("Backend dev", "https://m.example/2", "Bergen"), "{}", None)], RAW)
    state, _ = run_batch(spark, PipelineState(), rows, 0)
    assert {r.field_name for r in state.comparisons.collect()} >= {"title", "broker"}
    assert state.primary.where("primary_record_id IS NOT NULL").count() == 2
    assert state.scores.count() == 2 and state.scores.where("role_category IS NULL").count() == 0
    assert state.evidence.count() == 2 and state.gaps.first().buyer_name == "Bergen"
    assert state.payloads.count() == state.digests.count() > 0
    assert json.loads(state.payloads.first().payload)["title"]
    # the same batch again leaves the state equal
    again, _ = run_batch(spark, state, rows, 1)
    for name in ("records", "clusters", "links", "comparisons", "primary", "scores", "gaps", "evidence", "digests", "payloads"):
        a, b = getattr(state, name), getattr(again, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect())), name


def test_store_never_reads_damage_as_empty(spark):
    root = tempfile.mkdtemp(prefix="tl-store-", dir="/tmp")
    assert store.read_state(spark, root) == (None, PipelineState())
    rows = spark.range(3).withColumnRenamed("id", "raw_id")
    store.write_state(spark, 0, PipelineState(raw=rows, links=rows), root)
    v, state = store.read_state(spark, root)
    assert v == 0 and state.raw.count() == 3 and state.gaps is None
    spark.createDataFrame([(1, ["raw"])], store.COMMIT_SCHEMA).write.mode("append").parquet(f"{root}/state/_committed")
    with pytest.raises(AnalysisException):
        store.read_state(spark, root)
    with pytest.raises(ValueError):
        store.read_state(spark, "")


def test_three_files_as_a_stream_are_three_runs(spark):
    base = tempfile.mkdtemp(prefix="tl-three-", dir="/tmp")
    files = [[(1, "scraper", "Mercell", "a", job("Data", "https://m.example/a")), (2, "scraper", "Mercell", "b", job("Web", "https://m.example/b"))],
             [(1, "scraper", "Mercell", "a", job("Data two", "https://m.example/a"))],
             [(1, "scraper", "Mercell", "c", job("Cloud", "https://m.example/c")), (2, "scraper", "Mercell", "a", job("Data two", "https://m.example/a"))]]
    for i, rows in enumerate(files):
        raw(spark, rows).select(*RAW_ITEM_SCHEMA.names).coalesce(1).write.mode("append").parquet(f"{base}/landed")
        start(spark, f"{base}/landed", f"{base}/ckpt", root=base).awaitTermination(900)
        _, state = store.read_state(spark, f"{base}/runs")
        store.write_state(spark, i, run_batch(spark, state, raw(spark, rows), i)[0], f"{base}/runs")
    _, state = store.read_state(spark, f"{base}/runs")
    v, got = store.read_state(spark, base)
    assert v == 2
    for name in ("raw", "records", "clusters", "links", "digests", "primary"):
        a, b = getattr(state, name), getattr(got, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect())), name


def test_two_decimals_are_those_of_the_stored_value(spark):
    values = [0.835, 0.575, 0.125, 0.375, 1.005, 2.675, 0.0, 1.0, 12345.675, 0.005, 0.015, 99.995, -0.835, 0.1 + 0.2, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(format_2dp("v")).collect()]
    assert got == [None if v is None else f"{v:.2f}" for v in values]


def test_string_zero_is_an_id(spark):
    doc = json.dumps([{"id": "0", "notice_id": "n"}, {"id": 0, "notice_id": "n"}, {"id": "false", "url": "u"}, {"id": "", "url": "u"}])
    assert [r.external_id for r in feeds(spark, (1, "x", doc)).orderBy("pos").collect()] == ["0", "n", "false", "u"]


def test_transitions_apply_once_and_in_order(spark):
    gaps = spark.createDataFrame([("g", "open", None), ("h", "open", "old")], "gap_key string, status string, note string")
    t = spark.createDataFrame([("g", "acknowledged", "first", 1), ("g", "ignored", None, 2), ("g", "nonsense", "x", 3), ("z", "open", None, 1)],
                              "gap_key string, status string, note string, seq int")
    out, refused = set_gap_status(gaps, t)
    assert sorted(map(tuple, out.collect())) == [("g", "ignored", "first"), ("h", "open", "old")] and refused.count() == 2
    clusters = spark.createDataFrame([(1, "needs_review")], "cluster_id long, review_status string")
    t = spark.createDataFrame([(1, "ignored", 1), (1, "nonsense", 2), (2, "ignored", 3)], "cluster_id long, status string, seq long")
    out, known, refused = apply_review(clusters, t)
    assert out.first().review_status == "ignored" and known.count() == 1 and refused.count() == 2


def test_two_acknowledgements_are_one_sent_item(spark):
    items = spark.createDataFrame([("d", 1, "s", None, None)], "digest_id string, cluster_id long, review_status string, message_ts string, sent_at timestamp")
    acks = spark.createDataFrame([("d", "1"), ("d", "2")], "digest_id string, message_ts string")
    out = mark_sent(items, acks, "2026-01-01 00:00:00").collect()
    assert len(out) == 1 and out[0].message_ts == "2"


def test_last_line_of_a_blank_cell_is_null(spark):
    df = spark.createDataFrame([("a\n b \n",), (" \n",), (None,)], "c string")
    assert [r[0] for r in df.select(last_line(F.col("c"))).collect()] == ["b", None, None]


def test_feed_precedence_of_three(spark):
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "source_name string")
    tag = lambda df, o: df.withColumn("o", F.lit(o))
    got = feed_precedence(tag(f("a"), "own"), tag(f("a", "b", "c"), "fetched"), tag(f("a", "b"), "shared"))
    assert sorted(map(tuple, got.collect())) == [("a", "own"), ("b", "shared"), ("c", "fetched")]


def test_mail_parts_and_bad_files(spark):
    m = _read_message(b"From: x@y.no\r\nSubject: =?utf-8?q?=C3=85?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
                      b"--B\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n\xe5a\r\n--B\r\nContent-Type: text/html\r\n\r\n<b>\r\n"
                      b"--B\r\nContent-Type: text/plain; charset=nope\r\n\r\nzz\r\n--B--\r\n")
    assert m["subject"] == "Å" and m["sender"] == "x@y.no" and m["body"].split() == ["åa", "zz"] and m["message_id"] is None
    folder = tempfile.mkdtemp(prefix="tl-mail-", dir="/tmp")
    with open(f"{folder}/7.eml", "wb") as f:
        f.write(b"Message-ID: <q>\r\nSubject: s\r\n\r\nbody")
    good, bad = read_landed_mail(spark, folder)
    r = good.first()
    assert (r.uid, r.message_id, r.body) == ("7", "<q>", "body") and bad.count() == 0


def test_a_cluster_must_name_the_shared_folder():
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://x", "getCheckpointDir": staticmethod(lambda: None)})
    with pytest.raises(ValueError):
        checkpoint_root(Far)


def test_portal_layouts_on_literal_pages(spark):
    from tenderlake.sources.pages import portal_listings
    pages = [
        (1, "https://p.example/x", "mercell", '<table><tr roworder="1"><th>h</th></tr><tr roworder="2"><td>0</td><td>1</td><td>2</td>'
         '<td>3</td><td><a href="/t/1" class="hide100pct b">A &amp; B</a> <a class="company-in-grid"> <svg/>Oslo </a></td>'
         '<td>\n 2026-01-02 </td><td>6</td></tr><tr><td>no order</td></tr></table>'),
        (2, "https://p.example/x", "witted", '<li data-list-item><h2 class="q">T<b>1</b></h2><p>d</p><a href="https://w/1">go</a></li><li>x</li>'),
        (3, "https://p.example/x", "emagine", '<article><a class="single-job" href="https://e/1"></a><h2 class="title">E</h2>'
         '<div class="start-date">Start\n <span id="convertedDate">\n 1 May\n</span></div></article>'),
        (4, "https://p.example/x", "verama", '<a class="other" href="/z">z</a><a class="route-section" href="/r"><span class="job-request-record__header">V</span></a>'),
        (5, "https://p.example/x", "folq", None), (6, "https://p.example/x", "other", "<li data-list-item></li>")]
    got = {r.source: r for r in portal_listings(spark.createDataFrame(pages, "page_id long, url string, source string, html string")).collect()}
    assert set(got) == {"mercell", "witted", "emagine", "verama"}
    m, w, e, v = (got[k] for k in ("mercell", "witted", "emagine", "verama"))
    assert (m.title, m.job_uri, m.company, m.delivery_date) == ("A & B", "https://p.example/t/1", "Oslo", "2026-01-02")
    assert (w.title, w.job_uri, w.description, w.delivery_date) == ("T1", "https://w/1", "d", None)
    assert (e.title, e.delivery_date) == ("E", "1 May") and (v.title, v.job_uri) == ("V", "https://p.example/r")


def test_signals_list_by_update_time(spark):
    from tenderlake.operators.signals import SIGNAL_COLS, list_signals, sync_signals
    names = [c for c in SIGNAL_COLS if c != "updated_at"]

    def flagged(key, seq):
        return spark.createDataFrame([tuple([key if c == "external_id" else seq if c == "seq" else "x" for c in names] + [True])],
                                     ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in names) + ", detected boolean")
    first = sync_signals(None, flagged("old", 900), "2026-01-01 00:00:00")
    both = sync_signals(first, flagged("new", 1), "2026-01-02 00:00:00")
    assert [r.external_id for r in list_signals(both).collect()] == ["new", "old"]
