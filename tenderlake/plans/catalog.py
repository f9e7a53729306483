"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Each query runs a library operator over the whole staged tables.  Output
columns are aliased to the names used by the matching oracle statement;
doubles are rounded to 6 places and arrays joined with '|'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.kinds import (contains_agreement_phrase, source_rank, with_priority_key,
                                        with_source_kind)
from tenderlake.functions.text import (content_hash, contains_keyword, first_truthy,
                                       normalize_text, normalize_url, url_host)
from tenderlake.operators.cluster import (apply_counts, cluster_key, comparisons, links_of_failed, primary_sources,
                                          refresh_primary, value_counts)
from tenderlake.operators.policy import FilterPolicy
from tenderlake.plans import inputs, staging
from tenderlake.session import stored
from tenderlake.plans.views import cluster_view, digest_payload, needs_review, relevant_opportunities, review_queue
from tenderlake.operators import digest as DG
from tenderlake.operators import analytics as AN
from tenderlake.operators import gaps as GP
from tenderlake.operators import signals as SG
from tenderlake.operators.policy import classify, include_in_digest, score_clusters
from tenderlake.operators import extract as X
from tenderlake.operators import state as ST
from tenderlake.sources import listings as SL
from tenderlake.sources import mail as SM
from tenderlake.sources import notices as SN
from tenderlake.sources import pages as SP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


def view_out(df: DataFrame) -> DataFrame:
    return (df.withColumn("confidence", r6("confidence"))
            .withColumn("relevance_score", r6("relevance_score"))
            .withColumn("role_tags", F.array_join("role_tags", "|")))


# ------------------------------------------------------------ flagship
@query("relevant_opportunities")
def q_relevant(spark: SparkSession, d: str) -> DataFrame:
    recs, clusters, links = inputs.listing_memberships(spark, d)
    top = relevant_opportunities(clusters, links, recs, FilterPolicy.build())
    return view_out(top)


# ------------------------------------------------------------ expressions
@query("normalize_text")
def q_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = staging.table(spark, d, "documents")
    n = normalize_text("text")
    return docs.select("doc_id", F.sha2(n, 256).alias("norm_hash"),
                       F.length(n).cast("bigint").alias("norm_len"))


@query("normalize_url")
def q_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return staging.table(spark, d, "pages").select("page_id", normalize_url("url").alias("norm_url"))


@query("content_hash")
def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return staging.table(spark, d, "documents").select("doc_id", content_hash("text").alias("content_hash"))


@query("url_host")
def q_url_host(spark: SparkSession, d: str) -> DataFrame:
    return staging.table(spark, d, "pages").select("page_id", url_host("url").alias("host"))


@query("cluster_key")
def q_cluster_key(spark: SparkSession, d: str) -> DataFrame:
    L = staging.stg_listing(spark, d)
    return L.select("seq", cluster_key("title", "customer", "deadline", "source_url").alias("cluster_key"))


@query("source_kind")
def q_source_kind(spark: SparkSession, d: str) -> DataFrame:
    L = staging.stg_listing(spark, d)
    return with_source_kind(L, platform="platform").select("seq", "source_kind")


@query("source_priority")
def q_source_priority(spark: SparkSession, d: str) -> DataFrame:
    recs = inputs.listing_records(spark, d)
    return (with_priority_key(recs).select("record_id", "priority_key")
            .withColumn("priority_rank", source_rank(F.col("priority_key")).cast("bigint")))


KEYWORD_SET = ["the", "and", "of the", "de", "la", "et", "der", "und", "die", "el", "los",
               "y", "que", "is", "für", "été"]


@query("keyword_match")
def q_keyword_match(spark: SparkSession, d: str) -> DataFrame:
    docs = staging.table(spark, d, "documents").select("doc_id", normalize_text("text").alias("h"))
    hits = [contains_keyword(F.col("h"), k) for k in KEYWORD_SET]
    n = sum((h.cast("bigint") for h in hits), F.lit(0).cast("bigint"))
    names = F.concat_ws("|", *[F.when(h, F.lit(k)) for h, k in zip(hits, KEYWORD_SET)])
    return docs.select("doc_id", n.alias("n_hits"), names.alias("matched"))


@query("agreement_phrase")
def q_agreement_phrase(spark: SparkSession, d: str) -> DataFrame:
    N = staging.stg_notice(spark, d)
    return N.select("seq", contains_agreement_phrase("agreement_type").alias("type_hit"),
                    contains_agreement_phrase("notice_type").alias("notice_hit"),
                    contains_agreement_phrase("title").alias("title_hit"))


@query("truthy_coalesce")
def q_truthy(spark: SparkSession, d: str) -> DataFrame:
    N = staging.stg_notice(spark, d)
    return N.select("seq", first_truthy("id", "notice_id", "external_id", "url").alias("external_key"),
                    first_truthy("buyer", "customer").alias("buyer_or_customer"))


# ------------------------------------------------------------ sources
def _raw_out(raw: DataFrame) -> DataFrame:
    return raw.select("seq", "source_type", "source_name", "external_id",
                      F.sha2("raw_body", 256).alias("body_hash"),
                      F.sha2("metadata", 256).alias("metadata_hash"))


@query("ingest_listings")
def q_ingest_listings(spark: SparkSession, d: str) -> DataFrame:
    return _raw_out(SL.listings_to_raw(inputs.listing_jobs(spark, d)))


@query("fallback_external_id")
def q_fallback_id(spark: SparkSession, d: str) -> DataFrame:
    jobs = inputs.listing_jobs(spark, d)
    return jobs.select("seq", SL.fallback_external_id(SL.listing_body()).alias("fallback_id"))


def _mail_raw(spark: SparkSession, d: str) -> DataFrame:
    return SM.mail_to_raw(staging.stg_mail(spark, d), inputs.MAIL_SOURCE)


@query("ingest_mail")
def q_ingest_mail(spark: SparkSession, d: str) -> DataFrame:
    return _raw_out(_mail_raw(spark, d))


@query("mail_since_uid")
def q_mail_since(spark: SparkSession, d: str) -> DataFrame:
    mail = SM.since_uid(staging.stg_mail(spark, d), inputs.UID_FLOOR)
    return SM.mail_to_raw(mail, inputs.MAIL_SOURCE).select("seq", "external_id")


def _notice_raw(spark: SparkSession, d: str) -> DataFrame:
    feeds = inputs.notice_feeds(spark, d)
    return SN.normalize_notices(SN.explode_feed(feeds))


@query("ingest_notices")
def q_ingest_notices(spark: SparkSession, d: str) -> DataFrame:
    return _notice_raw(spark, d).select("seq", "source_name", "external_id",
                                        F.sha2("raw_body", 256).alias("body_hash"))


@query("ingest_multi_notice")
def q_ingest_multi(spark: SparkSession, d: str) -> DataFrame:
    """A6 on feed documents that hold many notices: each keeps its place."""
    raw = SN.normalize_notices(SN.explode_feed(inputs.order_feeds(spark, d)))
    return raw.select("seq", "pos", "source_name", "external_id", F.sha2("raw_body", 256).alias("body_hash"))


@query("notice_normalize")
def q_notice_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = _notice_raw(spark, d)
    meta = raw.select("seq", "external_id", F.from_json("metadata", X.NOTICE_META).alias("_m"))
    return meta.select("seq", "external_id", *[f"_m.{c}" for c in ("title", "url", "buyer", "agreement_type",
                                                                   "notice_type", "origin")])


@query("feed_precedence")
def q_feed_precedence(spark: SparkSession, d: str) -> DataFrame:
    N = staging.stg_notice(spark, d)
    notices = N.select("seq", "source_name", F.parse_json(inputs.notice_json(N)).alias("notice"))
    # one source has a feed of its own (odd lines only), two are in a shared
    # one (even lines only), and all are fetched, the third as nothing else
    odd = F.col("seq") % 2 == 1
    embedded = notices.where((F.col("source_name") == "doffin") & odd).withColumn("origin", F.lit("embedded"))
    shared = notices.where(F.col("source_name").isin("doffin", "kgv-portal") & ~odd).withColumn(
        "origin", F.lit("shared"))
    fetched = notices.withColumn("origin", F.lit("fetched"))
    return SN.feed_precedence(embedded, fetched, shared).select("seq", "source_name", "origin")


@query("ingest_quarantine")
def q_quarantine(spark: SparkSession, d: str) -> DataFrame:
    q = SN.quarantine(inputs.notice_feeds(spark, d))
    return q.groupBy("source_name", "reason").agg(F.count(F.lit(1)).alias("n_documents"))


# ------------------------------------------------------------ extraction
def _rec_out(rec: DataFrame) -> DataFrame:
    return rec.select("raw_id", "title", "customer", "broker", "source_url", "deadline",
                      F.sha2(F.coalesce("description", F.lit("")), 256).alias("description_hash"),
                      "summary", "source_type", "source_kind", "platform", "host", "agreement_type",
                      "notice_type", "category", F.round("extraction_confidence", 6).alias("extraction_confidence"),
                      "extraction_error")


@query("extract_email")
def q_extract_email(spark: SparkSession, d: str) -> DataFrame:
    return _rec_out(X.extract_email(inputs.with_raw_ids(_mail_raw(spark, d))))


@query("extract_listing")
def q_extract_listing(spark: SparkSession, d: str) -> DataFrame:
    raw = inputs.with_raw_ids(SL.listings_to_raw(inputs.listing_jobs(spark, d)))
    return _rec_out(X.extract_listing(raw))


@query("extract_notice")
def q_extract_notice(spark: SparkSession, d: str) -> DataFrame:
    return _rec_out(X.extract_notice(inputs.notice_raw(spark, d)))


def all_raw(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Listings, mail and notices of one run; seq made unique per source.  With
    ``only`` (raw_id), the items of these ids: the staged rows of others are
    left out before items are made of them."""
    def some(staged: DataFrame, seq: str, kind: int) -> DataFrame:
        if only is None:
            return staged
        return staged.join(only.select(F.col("raw_id").alias("_id")), F.col(seq) * 4 + kind == F.col("_id"), "left_semi")
    lst = SL.listings_to_raw(some(inputs.listing_jobs(spark, d), "seq", 1)).withColumn("seq", F.col("seq") * 4 + 1)
    mail = SM.mail_to_raw(some(staging.stg_mail(spark, d), "uid", 2), inputs.MAIL_SOURCE).withColumn("seq", F.col("seq") * 4 + 2)
    notice = inputs.notice_raw(spark, d, some(staging.stg_notice(spark, d), "seq", 3)).drop(
        "raw_id", "content_hash", "pos").withColumn("seq", F.col("seq") * 4 + 3)
    return inputs.with_raw_ids(lst.unionByName(mail).unionByName(notice, allowMissingColumns=True))


@query("extract_all")
def q_extract_all(spark: SparkSession, d: str) -> DataFrame:
    return _rec_out(X.extract(all_raw(spark, d)))


@query("extract_errors")
def q_extract_errors(spark: SparkSession, d: str) -> DataFrame:
    _, bad = X.split_errors(X.extract(all_raw(spark, d)))
    bad = stored(bad, "errors")
    # what failed is known by id: no other row becomes an item again
    items = all_raw(spark, d, bad).select("raw_id", "source_type", "external_id")
    return bad.join(items, "raw_id").select("raw_id", "source_type", "external_id", "extraction_error")


# ------------------------------------------------------------ raw state
def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new = inputs.version_batches(spark, d)
    stored = ST.upsert_raw(None, old).drop("changed")
    return stored, ST.upsert_raw(stored, new)


@query("raw_upsert")
def q_raw_upsert(spark: SparkSession, d: str) -> DataFrame:
    _, final = _upserted(spark, d)
    return final.select("raw_id", "source_name", "external_id", "content_hash", "seq", "changed",
                        F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


@query("latest_record")
def q_latest_record(spark: SparkSession, d: str) -> DataFrame:
    V = staging.stg_versions(spark, d)
    recs = V.select(F.concat_ws(":", "source_name", "external_id").alias("raw_id"),
                    F.col("seq").alias("record_id"), F.sha2("raw_body", 256).alias("raw_content_hash"))
    return ST.latest_records(recs).select("raw_id", "record_id", "raw_content_hash")


@query("incremental_reextract")
def q_incremental(spark: SparkSession, d: str) -> DataFrame:
    stored, final = _upserted(spark, d)
    old_records = stored.select("raw_id", F.col("seq").alias("record_id"),
                                F.col("content_hash").alias("raw_content_hash"))
    _, new = inputs.version_batches(spark, d)
    in_batch = final.join(new.select(*ST.KEY).distinct(), ST.KEY, "left_semi")
    plan = ST.reextract_plan(in_batch, ST.latest_records(old_records))
    return plan.select("raw_id", "source_name", "external_id", "action")


# ------------------------------------------------------------ clustering
def _links_out(links: DataFrame) -> DataFrame:
    return links.select("cluster_id", "record_id", r6("match_confidence").alias("match_confidence"),
                        "match_rationale")


@query("cluster_upsert")
def q_cluster_upsert(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    return sc.result.clusters.select("cluster_id", "cluster_key", "title", "customer",
                                     r6("confidence").alias("confidence"), "review_status")


@query("cluster_links")
def q_cluster_links(spark: SparkSession, d: str) -> DataFrame:
    return _links_out(inputs.cluster_scenario(spark, d).result.links)


@query("cluster_similarity")
def q_cluster_similarity(spark: SparkSession, d: str) -> DataFrame:
    _, res = inputs.listing_clusters(spark, d)
    return _links_out(res.links)


@query("detach_superseded")
def q_detach_superseded(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    removed = sc.links_after_failures.join(sc.result.links.select("cluster_id", "record_id"),
                                           ["cluster_id", "record_id"], "left_anti")
    return removed.select("cluster_id", "record_id")


@query("detach_failed")
def q_detach_failed(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    removed = sc.state_links.join(sc.links_after_failures.select("cluster_id", "record_id"),
                                  ["cluster_id", "record_id"], "left_anti")
    return removed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("removed_links"))


@query("comparisons")
def q_comparisons(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    return comparisons(sc.result.links, sc.all_records).select(
        "cluster_id", "field_name", "value", F.col("n_values").cast("bigint").alias("n_values"))


@query("comparison_counts")
def q_comparison_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stored value counts with the batch's new links added and its
    failed and superseded ones taken off."""
    sc = inputs.cluster_scenario(spark, d)
    gone = links_of_failed(sc.state_links, sc.old_records, sc.failed_raw).select("cluster_id", "record_id").unionByName(sc.result.removed)
    counts = apply_counts(value_counts(sc.state_links, sc.old_records), value_counts(sc.result.new_links, sc.batch_records),
                          value_counts(gone, sc.old_records))
    return counts.select("cluster_id", "field_name", "value", "n")


@query("primary_source")
def q_primary_source(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    p = primary_sources(sc.result.clusters, sc.result.links, sc.all_records)
    return p.select("cluster_id", "primary_record_id", "source_count")


@query("touched_clusters")
def q_touched(spark: SparkSession, d: str) -> DataFrame:
    return inputs.cluster_scenario(spark, d).result.touched.select("cluster_id")


# ------------------------------------------------------------ policy
CAPACITY_PROFILE = {"data_engineering": 2, "backend": 0, "frontend": 7, "security": 1}


@query("role_classify")
def q_role_classify(spark: SparkSession, d: str) -> DataFrame:
    recs, clusters, links = inputs.listing_memberships(spark, d)
    roles = classify(clusters, links, recs, FilterPolicy.build())
    return roles.select("cluster_id", "role_category", F.array_join("role_tags", "|").alias("role_tags"))


PHRASE_TAXONOMY = {
    "four": ["and attion to thanedble", "the the the the", "of of of of", "und und und und"],
    "three": ["of the and", "in the of", "to thanedble the", "the and the", "de la la"],
    "two": ["of the", "the of", "de la", "und der", "la la"],
    "six": ["and attion to thanedble the, anea", "stteen erachtz. ietzte. stteen erachtz. ietzte"],
    "one": ["attion"],
}


@query("role_classify_phrases")
def q_role_phrases(spark: SparkSession, d: str) -> DataFrame:
    """F1 with keywords of up to six words over clusters whose every record is
    one word."""
    recs, clusters, links = inputs.word_records(spark, d)
    roles = classify(clusters, links, recs, FilterPolicy.build(PHRASE_TAXONOMY))
    return roles.select("cluster_id", "role_category", F.array_join("role_tags", "|").alias("role_tags"))


@query("relevance_score")
def q_relevance(spark: SparkSession, d: str) -> DataFrame:
    recs, clusters, links = inputs.listing_memberships(spark, d)
    pol = FilterPolicy.build(capacity=CAPACITY_PROFILE, mode="high_recall")
    s = score_clusters(clusters, links, recs, pol)
    return s.select("cluster_id", "role_category", r6("relevance_score").alias("relevance_score"),
                    "relevance_rationale")


@query("digest_candidates")
def q_digest_candidates(spark: SparkSession, d: str) -> DataFrame:
    ds = inputs.digest_scenario(spark, d)
    s = ds.scored
    inc = include_in_digest(F.col("review_status"), F.col("confidence"), F.col("relevance_score"),
                            FilterPolicy.build())
    return s.where(inc).select("cluster_id", "review_status", r6("relevance_score").alias("relevance_score"))


@query("cluster_search")
def q_cluster_search(spark: SparkSession, d: str) -> DataFrame:
    recs, clusters, links = inputs.listing_memberships(spark, d)
    v = cluster_view(clusters, links, recs, FilterPolicy.build(), q="nation_1", min_relevance=0.5)
    return view_out(v)


def _stored_primary(sc) -> DataFrame:
    """The stored primary records with the batch's touched clusters refreshed,
    as a run does before it plans the digest."""
    stored = primary_sources(sc.state_clusters, sc.state_links, sc.old_records)
    return refresh_primary(stored, sc.result.clusters, sc.result.links, sc.all_records, sc.result.touched)


@query("digest_payload")
def q_digest_payload(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    p = digest_payload(sc.result.clusters, sc.result.links, sc.all_records,
                       stored_primary=_stored_primary(sc))
    return p.select("cluster_id", "title", "customer", "deadline", "source_count", "primary_record_id",
                    r6("confidence").alias("confidence"), "review_status")


@query("digest_message")
def q_digest_message(spark: SparkSession, d: str) -> DataFrame:
    ds = inputs.digest_scenario(spark, d)
    sc = ds.clusters
    p = digest_payload(sc.result.clusters, sc.result.links, sc.all_records, scored=ds.scored,
                       stored_primary=_stored_primary(sc))
    return DG.message_columns(p)


@query("digest_plan")
def q_digest_plan(spark: SparkSession, d: str) -> DataFrame:
    return inputs.digest_scenario(spark, d).plan.select("cluster_id", "action", "emit")


@query("digest_plan_gated")
def q_digest_plan_gated(spark: SparkSession, d: str) -> DataFrame:
    """The plan while the gate is closed: items are planned, nothing is sent."""
    ds = inputs.digest_scenario(spark, d)
    gate = DG.cadence_gate(ds.digests, inputs.RUN_AS_OF, 7 * 24 * 60).select("blocked")
    inc = include_in_digest(F.col("review_status"), F.col("confidence"), F.col("relevance_score"),
                            FilterPolicy.build())
    plan = DG.plan_digest(ds.scored.crossJoin(gate), ds.digests, inc, F.col("blocked"))   # gate is one row
    return plan.select("cluster_id", "action", "emit", "blocked")


@query("digest_mark_sent")
def q_digest_mark_sent(spark: SparkSession, d: str) -> DataFrame:
    ds = inputs.digest_scenario(spark, d)
    state = DG.apply_plan(ds.digests, ds.plan, F.col("cluster_id") * 2)
    emitted = ds.plan.where(F.col("emit")).join(
        ds.clusters.result.clusters.select("cluster_id", F.col("customer").alias("_cust")), "cluster_id")
    # a post fails (no acknowledgement) when the cluster has no customer
    acks = emitted.where(F.col("_cust").isNotNull()).select(
        F.when(F.col("action") == "update_unsent", F.col("unsent_digest_id"))
        .otherwise(F.col("cluster_id") * 2).alias("digest_id"),
        F.concat(F.lit("m-"), F.col("cluster_id").cast("string")).alias("message_ts"))
    out = DG.mark_sent(state, acks, inputs.RUN_AS_OF)
    return out.select("digest_id", "cluster_id", "review_status", "message_ts",
                      F.unix_micros("sent_at").alias("sent_us"))


@query("pending_digests")
def q_pending(spark: SparkSession, d: str) -> DataFrame:
    ds = inputs.digest_scenario(spark, d)
    return DG.pending_clusters(ds.clusters.result.clusters, ds.digests).select("cluster_id")


CADENCE_AS_OF = "2024-01-30 23:00:00"
CADENCE_MINUTES = (0, 30, 100_000)


@query("cadence_gate")
def q_cadence(spark: SparkSession, d: str) -> DataFrame:
    """The gate over all events as sent times, for several lengths: off, too
    short to block, and long enough."""
    sent = staging.table(spark, d, "events").select(F.col("ts").alias("sent_at"))
    out = None
    for minutes in CADENCE_MINUTES:
        g = DG.cadence_gate(sent, CADENCE_AS_OF, minutes).select(
            F.lit(minutes).cast("bigint").alias("minutes"),
            F.unix_micros(F.col("latest_sent_at").cast("timestamp")).alias("latest_us"), "blocked")
        out = g if out is None else out.unionByName(g)
    return out


@query("review_queue")
def q_review_queue(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    # nobody reads the comparisons of other clusters
    comp = comparisons(sc.result.links, sc.all_records, needs_review(sc.result.clusters))
    rq = review_queue(sc.result.clusters, comp)
    return rq.select("cluster_id", "title", "customer", r6("confidence").alias("confidence"), "field_name", "value")


# ------------------------------------------------------------ signals
SIG_OUT = ["source_name", "external_id", "title", "buyer_name", "agreement_type", "category", "status",
           "source_url", "published_at", "deadline"]


@query("signal_detect")
def q_signal_detect(spark: SparkSession, d: str) -> DataFrame:
    det = SG.detect_signals(inputs.notice_items(spark, d)).where(F.col("detected"))
    return det.select(*SIG_OUT, r6("signal_confidence").alias("signal_confidence"))


@query("signal_sync")
def q_signal_sync(spark: SparkSession, d: str) -> DataFrame:
    return inputs.signal_scenario(spark, d, "title", "agreement_type").select("source_name", "external_id", "title", "agreement_type")


@query("signal_list")
def q_signal_list(spark: SparkSession, d: str) -> DataFrame:
    lst = SG.list_signals(inputs.all_signals(spark, d, "buyer_name"), buyer="nation_1")
    return lst.select("source_name", "external_id", "buyer_name", "seq")


# ------------------------------------------------------------ gaps
def _gap_out(g: DataFrame) -> DataFrame:
    return g.select("gap_key", "buyer_name", "status", "note", r6("confidence").alias("confidence"),
                    "cluster_count")


@query("gap_discovery")
def q_gap_discovery(spark: SparkSession, d: str) -> DataFrame:
    return _gap_out(inputs.gap_scenario(spark, d)[2].upserted)


@query("gap_autoclose")
def q_gap_autoclose(spark: SparkSession, d: str) -> DataFrame:
    return inputs.gap_scenario(spark, d)[2].closed.select("gap_key", "status", "note")


@query("gap_upsert")
def q_gap_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _gap_out(inputs.gap_scenario(spark, d)[2].gaps)


@query("gap_status")
def q_gap_status(spark: SparkSession, d: str) -> DataFrame:
    gaps = inputs.gap_scenario(spark, d)[2].gaps
    m = F.col("first_cluster_id") % 3
    t = gaps.where(m.isin(0, 1)).select(
        "gap_key", F.when(m == 0, F.lit("acknowledged")).otherwise(F.lit("watch_only")).alias("status"),
        F.when(m == 1, F.lit("check later")).alias("note"), F.lit(1).alias("seq"))
    # some are moved twice; an unknown buyer and an unknown status are refused
    again = gaps.where(F.col("first_cluster_id") % 6 == 0).select(
        "gap_key", F.lit("ignored").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(2).alias("seq"))
    odd = gaps.select("gap_key", F.lit("closed").alias("status"), F.lit("no").alias("note"), F.lit(3).alias("seq"))
    unknown = spark.createDataFrame([("buyer:nobody", "acknowledged", None, 1)],
                                    "gap_key string, status string, note string, seq int")
    out, _ = GP.set_gap_status(gaps, t.unionByName(again).unionByName(odd).unionByName(unknown))
    return out.select("gap_key", "status", "note")


@query("gap_list")
def q_gap_list(spark: SparkSession, d: str) -> DataFrame:
    return GP.list_gaps(inputs.gap_scenario(spark, d)[2].gaps, "open").select(
        "gap_key", r6("confidence").alias("confidence"))


@query("coverage_summary")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    _, signals, gr = inputs.gap_scenario(spark, d)
    return AN.coverage_summary(signals, gr.gaps).select(
        F.col("agreement_signal_count").cast("bigint").alias("agreement_signal_count"),
        F.col("gap_count").cast("bigint").alias("gap_count"),
        F.col("open_gap_count").cast("bigint").alias("open_gap_count"))


# ------------------------------------------------------------ analytics
@query("buyer_trends")
def q_buyer_trends(spark: SparkSession, d: str) -> DataFrame:
    _, clusters, _ = inputs.listing_memberships(spark, d)
    return AN.buyer_trends(clusters).select(
        "buyer", F.col("opportunity_count").cast("bigint").alias("opportunity_count"),
        r6("avg_confidence").alias("avg_confidence"))


@query("broker_patterns")
def q_broker_patterns(spark: SparkSession, d: str) -> DataFrame:
    return AN.broker_patterns(inputs.listing_records(spark, d)).select(
        "broker", F.col("record_count").cast("bigint").alias("record_count"),
        F.col("unique_buyers").cast("bigint").alias("unique_buyers"))


@query("source_quality")
def q_source_quality(spark: SparkSession, d: str) -> DataFrame:
    sc = inputs.cluster_scenario(spark, d)
    comp = comparisons(sc.result.links, sc.all_records)
    return AN.source_quality(sc.result.clusters, sc.result.links, comp).select(
        F.col("cluster_count").cast("bigint").alias("cluster_count"),
        F.col("clusters_with_conflicts").cast("bigint").alias("clusters_with_conflicts"),
        r6("conflict_ratio").alias("conflict_ratio"),
        r6("average_sources_per_cluster").alias("average_sources_per_cluster"))


@query("market_summary")
def q_market_summary(spark: SparkSession, d: str) -> DataFrame:
    """K5: all four reports in one table."""
    sc, signals, gr = inputs.gap_scenario(spark, d)
    _, clusters, _ = inputs.listing_memberships(spark, d)
    out = AN.market_summary(
        AN.buyer_trends(clusters), AN.broker_patterns(inputs.listing_records(spark, d)),
        AN.source_quality(sc.result.clusters, sc.result.links, comparisons(sc.result.links, sc.all_records)),
        AN.coverage_summary(signals, gr.gaps))
    return out.select("section", "name", "metric", r6("value").alias("value"))


REVIEW_STATUS_BY_ORDER = "CASE order_status WHEN 'F' THEN 'watch_only' WHEN 'O' THEN 'ignored' ELSE 'manually_merged' END"


@query("review_transition")
def q_review_transition(spark: SparkSession, d: str) -> DataFrame:
    recs, res = inputs.listing_clusters(spark, d)
    keyed = recs.where(~inputs.order_is_old()).withColumn(
        "cluster_key", cluster_key("title", "customer", "deadline", "source_url"))
    t = keyed.join(res.clusters.select("cluster_id", "cluster_key"), "cluster_key").select(
        "cluster_id", F.expr(REVIEW_STATUS_BY_ORDER).alias("status"), "seq")
    out, _, _ = AN.apply_review(res.clusters, t)
    return out.where(F.col("n_transitions").isNotNull()).select(
        "cluster_id", "review_status", F.col("n_transitions").cast("bigint").alias("n_transitions"))


# ------------------------------------------------------------ pages and listing stores
@query("page_listings")
def q_page_listings(spark: SparkSession, d: str) -> DataFrame:
    return SP.page_listings(staging.table(spark, d, "pages"))


def portal_pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored list pages of the five portals, 20 listings each, written from
    the staged listings, with the rows that a reader must skip."""
    L = staging.stg_listing(spark, d)
    t, c, due = (F.coalesce(x, F.lit("")) for x in ("title", "customer", "deadline"))
    esc = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    n = F.col("seq").cast("string")
    item = F.element_at(F.array(
        F.concat(F.lit('<tr><th>Head</th></tr><tr><td>pager</td></tr><tr roworder="1"><td>short</td></tr>'
                       '<tr class="r" roworder="2"><td>1</td><td>2</td><td></td><td>4</td><td><a class="x hide100pct" href="/t/'), n,
                 F.lit('"> '), esc(t), F.lit('\n</a><a class="company-in-grid"><svg></svg>'), esc(c), F.lit("</a></td><td> "), due,
                 F.lit(" </td><td>7</td></tr>")),
        F.concat(F.lit('<li>menu</li><li class="c" data-list-item="1"><h2>'), esc(t), F.lit('</h2><a href="https://w.example/'), n,
                 F.lit('">more</a><p>'), esc(c), F.lit("</p></li>")),
        F.concat(F.lit('<article><a class="single-job" href="https://e.example/'), n, F.lit('"><h2 class="title">'), esc(t),
                 F.lit('</h2></a><div class="start-date">Start\n  '), due, F.lit("\n</div></article>")),
        F.concat(F.lit('<a href="/no">x</a><a class="route-section" href="/job/'), n,
                 F.lit('"><span class="job-request-record__header">'), esc(t), F.lit("</span></a>")),
        F.concat(F.lit('<div><a href="/b/'), n, F.lit('">'), esc(t), F.lit(f"</a><div {SP._BLOCK_COMPANY}>"), esc(c), F.lit("</div>"),
                 F.when(due != "", F.concat(F.lit(f"<div {SP._BLOCK_DATE}>"), due, F.lit("</div>"))).otherwise(F.lit("")),
                 F.lit("</div>"))), F.col("kind"))
    rows = L.withColumn("page", F.expr("seq div 20")).withColumn("kind", (F.col("page") % 5 + 1).cast("int"))
    names = F.array(*[F.lit(x) for x in SP.LAYOUTS])
    return (rows.groupBy("page", "kind").agg(F.sort_array(F.collect_list(F.struct("seq", item.alias("i")))).alias("is"))
            .select(F.col("page").alias("page_id"), F.element_at(names, F.col("kind")).alias("source"),
                    F.lit("https://portal.example/list?page=0").alias("url"),
                    F.concat(F.lit("<html><body>"), F.array_join(F.transform("is", lambda x: x["i"]), "\n"),
                             F.lit("</body></html>")).alias("html")))


@query("page_listings_portals")
def q_page_portals(spark: SparkSession, d: str) -> DataFrame:
    """The five portal layouts, read back from stored pages."""
    got = SP.portal_listings(portal_pages(spark, d))
    return got.select("source", "page_id", "title", "job_uri", "company", "description", "delivery_date")


@query("listing_detail_join")
def q_listing_detail(spark: SparkSession, d: str) -> DataFrame:
    L = staging.stg_listing(spark, d)
    uri = F.concat(F.lit("https://example.com/job/"), F.col("seq").cast("string"))
    overview = L.select("seq", uri.alias("job_uri"), F.col("deadline").alias("delivery_date"),
                        F.col("customer").alias("company"), F.lit("").alias("description"))
    detail = L.where(F.col("order_status") == "F").select(
        uri.alias("job_uri"), F.concat(F.coalesce("deadline", F.lit("")), F.lit(" (frist)")).alias("deadline"),
        F.lower("customer").alias("company"), F.col("description"))
    out = SL.enrich_with_detail(overview, detail)
    return out.select("seq", "job_uri", "delivery_date", "company",
                      F.sha2("description", 256).alias("description_hash"))


def _jobs_split(spark: SparkSession, d: str):
    L = staging.stg_listing(spark, d)
    jobs = L.select("seq", F.col("source_url").alias("job_id"), "title", "order_ts")
    return jobs.where(inputs.order_is_old()).drop("order_ts"), jobs.where(~inputs.order_is_old()).drop("order_ts")


@query("new_listings")
def q_new_listings(spark: SparkSession, d: str) -> DataFrame:
    known, scraped = _jobs_split(spark, d)
    return SL.new_listings(scraped, known).select("seq", "job_id")


@query("known_listings_update")
def q_known_update(spark: SparkSession, d: str) -> DataFrame:
    known, scraped = _jobs_split(spark, d)
    return SL.update_known(known, scraped).select("seq", "job_id")


@query("mail_decode")
def q_mail_decode(spark: SparkSession, d: str) -> DataFrame:
    """Landed RFC-822 messages (built from stg_mail) decoded in Arrow batches."""
    # orders are few bytes a row: a scan task would decode a million messages
    m = staging.stg_mail(spark, d).repartition("uid")
    text = F.concat(F.lit("Message-ID: "), F.coalesce("message_id", F.lit("")), F.lit("\r\nFrom: "), F.col("sender"),
                    F.lit("\r\nSubject: "), F.col("subject"),
                    F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), F.col("body"))
    files = m.select(F.concat(F.lit("landed/"), F.col("uid").cast("string"), F.lit(".eml")).alias("path"),
                     F.encode(text, "UTF-8").alias("content"))
    dec = SM.decode_messages(files)
    return dec.select(F.col("uid").cast("bigint").alias("uid"), "subject", "sender", "_error")


@query("schema_align")
def q_schema_align(spark: SparkSession, d: str) -> DataFrame:
    """Clusters written before the role columns existed, backfilled."""
    from tenderlake.schemas import CLUSTER_SCHEMA, align_to_schema
    _, res = inputs.listing_clusters(spark, d)
    a = align_to_schema(res.clusters, CLUSTER_SCHEMA)
    return a.select("cluster_id", "review_status", F.array_join("role_tags", "|").alias("role_tags"),
                    r6("relevance_score").alias("relevance_score"))


# ------------------------------------------------------------ full run
@query("run_summary")
def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """One pipeline run over all staged raw items (listings, mail,
    notices) from empty state; the run summary row (rows-only check)."""
    from tenderlake.plans.pipeline import PipelineState, run_batch
    raw = all_raw(spark, d).select("seq", "source_type", "source_name", "external_id", "raw_body",
                                   "metadata", "received_at")
    _, summary = run_batch(spark, PipelineState(), raw, 1, as_of=inputs.RUN_AS_OF)
    return summary.select(*[F.col(c).cast("bigint").alias(c) for c in summary.columns])
