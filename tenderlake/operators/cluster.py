"""Entity resolution: records -> clusters, links, comparisons, primary source.

The original processes records one at a time; results depend on arrival
order.  Here order is the record id (``record_id``: later = newer) and every
order-dependent quantity is computed with aggregates + joins, never with a
per-cluster array or a window over the whole cluster.  Aggregates combine
before the shuffle, and every join of records or links on their cluster deals
out the rows of heavy clusters (:mod:`tenderlake.operators.skew`), so a hot key
(e.g. the all-empty key ``||``) never lands in one task.

Record columns used: record_id, raw_id, title, customer, broker, deadline,
source_url, source_type, source_kind, platform, host, extraction_confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import fixed
from tenderlake.functions.kinds import source_rank, with_priority_key
from tenderlake.functions.text import normalize_text, normalize_url, truthy
from tenderlake.operators.skew import PART, HeavyKeys, spread_join

CLUSTER_COLS = ["cluster_id", "cluster_key", "title", "customer", "confidence",
                "review_status"]
LINK_COLS = ["cluster_id", "record_id", "match_confidence", "match_rationale"]
COMPARED_FIELDS = ("title", "customer", "broker", "deadline", "source_url")
KEYED_COLS = ["cluster_key", "_has_url", "_dl", "_rec_conf", "_rec_status"]
COUNT_COLS = ["cluster_id", "field_name", "value", "n"]


def cluster_key(title, customer, deadline, source_url) -> Column:
    """Normalized URL, else ``nt(title)|nt(customer)|nt(deadline)``."""
    nu = normalize_url(source_url)
    return F.when(nu != "", nu).otherwise(
        F.concat_ws("|", normalize_text(title), normalize_text(customer),
                    normalize_text(deadline)))


def with_cluster_key(records: DataFrame) -> DataFrame:
    """Add cluster_key, the per-record cluster confidence and status, and what
    scores compare (whether the key is a URL, the normalized deadline).  Records
    that have them already, as stored ones may, are returned as they are."""
    if set(KEYED_COLS) <= set(records.columns):
        return records
    # the URL is normalized once, the texts of the key only where there is none
    records = records.withColumn("_url", normalize_url("source_url")).withColumn("_dl", normalize_text("deadline"))
    has_url = F.col("_url") != ""
    key = F.when(has_url, F.col("_url")).otherwise(
        F.concat_ws("|", normalize_text("title"), normalize_text("customer"), F.col("_dl")))
    conf = F.when(F.col("_has_url"), F.lit(fixed.URL_CLUSTER_CONFIDENCE)).otherwise(
        F.lit(fixed.KEY_CLUSTER_CONFIDENCE))
    return (records
            .withColumn("cluster_key", key).withColumn("_has_url", has_url).drop("_url")
            .withColumn("_rec_conf", conf)
            .withColumn("_rec_status",
                        F.when(F.col("_rec_conf") >= F.lit(fixed.AUTO_ACCEPT_MIN_CONFIDENCE), "auto_accepted")
                        .otherwise("needs_review")))


def _first_truthy(col: str) -> Column:
    """(value, record_id) of the first record with a truthy value."""
    v = F.col(col)
    return F.min_by(F.struct(v.alias("v"), F.col("record_id").alias("s")),
                    F.when(truthy(v).isNotNull(), F.col("record_id")))


def batch_cluster_summary(keyed: DataFrame) -> DataFrame:
    """One row per cluster key of the batch (partial-aggregation friendly)."""
    return (keyed.groupBy("cluster_key").agg(
        F.min("record_id").alias("b_first_id"),
        F.count(F.lit(1)).alias("b_rows"),
        _first_truthy("title").alias("b_title"),
        _first_truthy("customer").alias("b_customer"),
        F.max("_rec_conf").alias("b_conf"),
        F.max_by("_rec_status", "record_id").alias("b_status")))


def upsert_clusters(summary: DataFrame, state: DataFrame | None) -> DataFrame:
    """Merge the batch summary into the cluster state.

    title/customer: stored truthy value, else the batch's first truthy one;
    confidence: max; status: replaced only while automated."""
    if state is None:
        return summary.select(
            F.col("b_first_id").alias("cluster_id"), "cluster_key",
            F.col("b_title.v").alias("title"), F.col("b_customer.v").alias("customer"),
            F.col("b_conf").alias("confidence"), F.col("b_status").alias("review_status"))
    s = state.select(*CLUSTER_COLS)
    j = s.join(summary, "cluster_key", "full_outer")
    in_batch = F.col("b_first_id").isNotNull()
    keep_status = F.col("review_status").isNotNull() & ~F.col("review_status").isin(
        *fixed.AUTOMATED_REVIEW_STATUSES)
    return j.select(
        F.coalesce("cluster_id", "b_first_id").alias("cluster_id"),
        "cluster_key",
        F.coalesce(truthy("title"), F.col("b_title.v"), F.col("title")).alias("title"),
        F.coalesce(truthy("customer"), F.col("b_customer.v"), F.col("customer")).alias("customer"),
        F.greatest("confidence", "b_conf").alias("confidence"),
        F.when(~in_batch | keep_status, F.col("review_status"))
        .otherwise(F.col("b_status")).alias("review_status"))


@dataclass
class ClusterResult:
    clusters: DataFrame      # full cluster table after the batch
    links: DataFrame         # full link table after the batch
    new_links: DataFrame     # links inserted by this batch (with scores)
    touched: DataFrame       # cluster_id of clusters the batch touched
    detached: DataFrame      # cluster_id of clusters that lost superseded links
    removed: DataFrame | None = None     # the superseded links (cluster_id, record_id)


def batch_keys(summary: DataFrame, state_clusters: DataFrame | None = None) -> DataFrame:
    """One row per cluster key of the batch: its cluster id, the batch's first
    title and customer, and the stored ones."""
    per_key = summary.select("cluster_key", "b_first_id", "b_title", "b_customer")
    if state_clusters is not None:
        st = state_clusters.select("cluster_key", F.col("cluster_id").alias("s_id"), F.col("title").alias("s_title"),
                                   F.col("customer").alias("s_customer"))
        per_key = per_key.join(st, "cluster_key", "left")
    else:
        per_key = per_key.select("*", F.lit(None).cast("bigint").alias("s_id"),
                                 *[F.lit(None).cast("string").alias(c) for c in ("s_title", "s_customer")])
    return per_key.withColumn("cluster_id", F.coalesce("s_id", "b_first_id")).drop("s_id", "b_first_id")


def match_scores(keyed: DataFrame, summary: DataFrame,
                 state_clusters: DataFrame | None = None,
                 prior_deadlines: DataFrame | None = None) -> DataFrame:
    """Order-dependent similarity of each batch record to its cluster.

    * url: the record has a normalized URL (then it *is* the key).
    * title/customer: equal (normalized) to the cluster's first truthy value
      as of this record — the stored one, else the batch's first truthy
      value if it arrived at or before this record, else empty.
    * deadline: the record's normalized deadline was already attached to the
      cluster before it (stored links or an earlier batch record).

    What is known of a key, and of a key and deadline, is one row each before
    records meet it, in two joins that deal out the records of heavy keys."""
    per_key = batch_keys(summary, state_clusters)
    keyed = keyed.select("cluster_key", "record_id", "title", "customer", "_has_url", "_dl")
    deadlines = (keyed.where(F.col("_dl") != "")
                 .select("cluster_key", "_dl", F.col("record_id").alias("_at"), F.lit(False).alias("_was")))
    if prior_deadlines is not None:
        deadlines = deadlines.unionByName(prior_deadlines.select(
            "cluster_key", "_dl", F.lit(None).cast("bigint").alias("_at"), F.lit(True).alias("_was")))
    # earliest batch record per (key, deadline), and whether a stored link has it
    deadlines = deadlines.groupBy("cluster_key", "_dl").agg(F.min("_at").alias("_dl_first"), F.max("_was").alias("_dl_prior"))
    heavy = HeavyKeys(summary, "cluster_key", "b_rows")
    r = heavy.dealt(keyed, "record_id").join(heavy.repeated(per_key), ["cluster_key", PART])
    r = r.join(heavy.repeated(deadlines), ["cluster_key", "_dl", PART], "left")

    def as_of(stored: str, first: str) -> Column:
        return F.coalesce(truthy(stored),
                          F.when(F.col(f"{first}.s") <= F.col("record_id"), F.col(f"{first}.v")))

    url_hit = F.col("_has_url")
    title_hit = normalize_text("title") == normalize_text(as_of("s_title", "b_title"))
    cust_hit = normalize_text("customer") == normalize_text(as_of("s_customer", "b_customer"))
    dl_hit = (F.col("_dl") != "") & (F.coalesce(F.col("_dl_prior"), F.lit(False)) |
                                     (F.coalesce(F.col("_dl_first"), F.col("record_id")) < F.col("record_id")))
    score = (F.when(url_hit, F.lit(fixed.MATCH_WEIGHT_URL)).otherwise(F.lit(0.0))
             + F.when(title_hit, F.lit(fixed.MATCH_WEIGHT_TITLE)).otherwise(F.lit(0.0))
             + F.when(cust_hit, F.lit(fixed.MATCH_WEIGHT_CUSTOMER)).otherwise(F.lit(0.0))
             + F.when(dl_hit, F.lit(fixed.MATCH_WEIGHT_DEADLINE)).otherwise(F.lit(0.0)))
    rationale = F.concat_ws(",", F.when(url_hit, F.lit("url")), F.when(title_hit, F.lit("title")),
                            F.when(cust_hit, F.lit("customer")), F.when(dl_hit, F.lit("deadline")))
    return r.select("cluster_id", "record_id",
                    F.least(score, F.lit(1.0)).alias("match_confidence"),
                    F.when(rationale == "", F.lit(fixed.WEAK_MATCH)).otherwise(rationale)
                    .alias("match_rationale"))


def memberships(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, links) of a batch without stored state where nobody reads
    match scores: one aggregate and one join."""
    keyed = with_cluster_key(batch)
    summary = batch_cluster_summary(keyed)
    clusters = upsert_clusters(summary, None)
    links = spread_join(keyed.select("cluster_key", "record_id"), clusters.select("cluster_id", "cluster_key"), "cluster_key",
                        "record_id", heavy=HeavyKeys(summary, "cluster_key", "b_rows"))
    return clusters, links.select("cluster_id", "record_id")


def cluster_records(batch: DataFrame, state_clusters: DataFrame | None = None,
                    state_links: DataFrame | None = None,
                    state_records: DataFrame | None = None) -> ClusterResult:
    """Cluster a batch of extracted records against optional stored state.

    ``state_records`` must hold every record referenced by ``state_links``
    (record_id, raw_id, deadline)."""
    keyed = with_cluster_key(batch)
    summary = batch_cluster_summary(keyed)
    clusters = upsert_clusters(summary, state_clusters)

    detached = None
    stale = None
    kept_links = None
    prior_dl = None
    if state_links is not None:
        sl = state_links.select(*LINK_COLS)
        rec_raw = state_records.select("record_id", "raw_id", "deadline")
        # Links of other versions of the raw items in this batch go away.
        batch_raw = keyed.select(F.col("raw_id"), F.col("record_id").alias("_new_rid")).distinct()
        linked = sl.join(rec_raw, "record_id", "left")
        stale = (linked.join(batch_raw, "raw_id")
                 .where(F.col("record_id") != F.col("_new_rid"))
                 .select("cluster_id", "record_id").distinct())
        kept_links = sl.join(stale, ["cluster_id", "record_id"], "left_anti")
        detached = stale.select("cluster_id").distinct()
        # deadlines already attached to each cluster (after the detach)
        prior_dl = (kept_links.join(rec_raw, "record_id")
                    .select("cluster_id", normalize_text("deadline").alias("_dl"))
                    .where(F.col("_dl") != "").distinct()      # one row per cluster and deadline meets the key
                    .join(clusters.select("cluster_id", "cluster_key"), "cluster_id")
                    .select("cluster_key", "_dl"))

    scored = match_scores(keyed, summary, state_clusters, prior_dl)
    if kept_links is not None:
        # An existing link keeps its original score.
        new_links = scored.join(kept_links.select("cluster_id", "record_id"),
                                ["cluster_id", "record_id"], "left_anti")
        links = kept_links.unionByName(new_links)
    else:
        new_links = scored
        links = scored
        detached = scored.select("cluster_id").limit(0)
    # every key of the batch has a record: its cluster is known without scores
    touched = batch_keys(summary, state_clusters).select("cluster_id").unionByName(detached).distinct()
    return ClusterResult(clusters=clusters, links=links, new_links=new_links,
                         touched=touched, detached=detached, removed=stale)


def _field_values(links: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster_id, field_name, value): the truthy raw values of the compared
    fields, a row for each linked record that has one."""
    rec = records.select("record_id", *COMPARED_FIELDS)
    stack = "stack(5, " + ", ".join(f"'{f}', {f}" for f in COMPARED_FIELDS) + ") AS (field_name, value)"
    return (links.select("cluster_id", "record_id").join(rec, "record_id").selectExpr("cluster_id", stack)
            .where(truthy("value").isNotNull()))


def diverging(values: DataFrame) -> DataFrame:
    """The comparisons that distinct (cluster_id, field_name, value) rows make:
    the values of fields with more than one."""
    values = values.select("cluster_id", "field_name", "value")
    counts = (values.groupBy("cluster_id", "field_name")
              .agg(F.count(F.lit(1)).alias("n_values"))
              .where(F.col("n_values") > 1))
    heavy = HeavyKeys.of(values, "cluster_id")
    return (heavy.dealt(values, "value").join(heavy.repeated(counts), ["cluster_id", "field_name", PART])
            .select("cluster_id", "field_name", "value", "n_values"))


def comparisons(links: DataFrame, records: DataFrame,
                touched: DataFrame | None = None) -> DataFrame:
    """Fields whose distinct truthy raw values differ across a cluster's
    sources (E4).  Long form: one row per (cluster_id, field_name, value);
    ``n_values`` is the number of distinct values of that field."""
    l = links.select("cluster_id", "record_id")
    if touched is not None:
        l = spread_join(l, touched.select("cluster_id").distinct(), "cluster_id", "record_id", "left_semi")
    return diverging(_field_values(l, records).distinct())


def value_counts(links: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster_id, field_name, value, n): how many of a cluster's linked
    records hold a value.  Counts of disjoint links add up, so a link that
    goes can be taken off again (:func:`apply_counts`)."""
    return (_field_values(links, records).groupBy("cluster_id", "field_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def apply_counts(stored: DataFrame | None, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Stored value counts after links came and went (both as value counts).
    A value whose last link went has no row; more going than was counted
    means that counts and links disagree, and raises."""
    rows = added.select(*COUNT_COLS)
    if removed is not None:
        rows = rows.unionByName(removed.select("cluster_id", "field_name", "value", (-F.col("n")).alias("n")))
    if stored is not None:
        rows = rows.unionByName(stored.select(*COUNT_COLS))
    n = F.col("n")
    return (rows.groupBy("cluster_id", "field_name", "value").agg(F.sum("n").alias("n"))
            .withColumn("n", F.when(n >= 0, n).otherwise(
                F.raise_error(F.lit("more links went than were counted")).cast("bigint")))
            .where("n > 0"))


def merge_comparisons(state: DataFrame | None, fresh: DataFrame,
                      touched: DataFrame) -> DataFrame:
    """Comparisons of touched clusters are replaced by the fresh ones;
    fields that no longer diverge disappear."""
    if state is None:
        return fresh
    kept = state.join(touched.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return kept.unionByName(fresh)


def record_rank(records: DataFrame) -> DataFrame:
    return with_priority_key(records, "_pkind").withColumn("_rank", source_rank(F.col("_pkind")))


def primary_sources(clusters: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """E5: per cluster, the linked record with the highest
    (source rank, extraction confidence or 0, record id); null when the
    cluster has no links."""
    ranked = record_rank(records).select(
        "record_id", "_rank", F.coalesce("extraction_confidence", F.lit(0.0)).alias("_conf"))
    best = (links.select("cluster_id", "record_id").join(ranked, "record_id")
            .groupBy("cluster_id")
            .agg(F.max_by("record_id", F.struct("_rank", "_conf", "record_id"))
                 .alias("primary_record_id"),
                 F.count(F.lit(1)).alias("source_count")))
    return (clusters.join(best, "cluster_id", "left")
            .withColumn("source_count", F.coalesce("source_count", F.lit(0)).cast("bigint")))


def refresh_primary(state: DataFrame | None, clusters: DataFrame, links: DataFrame, records: DataFrame,
                    touched: DataFrame) -> DataFrame:
    """(cluster_id, primary_record_id) with the touched clusters computed
    anew and all others as stored."""
    ids = touched.select("cluster_id").distinct()
    fresh = primary_sources(clusters.join(ids, "cluster_id", "left_semi"),
                            spread_join(links, ids, "cluster_id", "record_id", "left_semi"), records).select(
                                "cluster_id", "primary_record_id")
    if state is None:
        return fresh
    return state.select("cluster_id", "primary_record_id").join(ids, "cluster_id", "left_anti").unionByName(fresh)


def _records_of(records: DataFrame, raw: DataFrame) -> DataFrame:
    return (records.select("record_id", "raw_id")
            .join(raw.select("raw_id").distinct(), "raw_id", "left_semi")
            .select("record_id"))


def links_of_failed(links: DataFrame, records: DataFrame, failed_raw: DataFrame) -> DataFrame:
    """The links of the records of raw items whose re-extraction failed."""
    return links.join(_records_of(records, failed_raw), "record_id", "left_semi")


def detach_records(links: DataFrame, records: DataFrame, failed_raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop every link of the records of raw items whose re-extraction
    failed.  Returns (kept links, affected cluster ids)."""
    kept = links.join(_records_of(records, failed_raw), "record_id", "left_anti")
    return kept, links_of_failed(links, records, failed_raw).select("cluster_id").distinct()
