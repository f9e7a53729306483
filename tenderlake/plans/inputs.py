"""Pipeline-shaped inputs derived from the staging views (shared by the
query catalog, the bench and the tests)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.kinds import with_source_kind
from tenderlake.functions.text import url_host
from tenderlake.operators.cluster import KEYED_COLS, ClusterResult, cluster_records, memberships, with_cluster_key
from tenderlake.plans import staging
from tenderlake.session import stored

# Records whose stored kind is missing (as in rows written before the kind
# was stored) exercise the rule-based priority path.
MISSING_KIND = "seq % 10 = 9"

# State tests split a staging view in time: rows dated before the cut were
# ingested by an earlier run ("stored"), the rest form the new batch.
ORDER_CUT = "1998-01-01"
EVENT_CUT = "2024-01-16"


def order_is_old(col: str = "order_ts") -> Column:
    return F.col(col) < F.lit(ORDER_CUT).cast("timestamp")


def event_is_old(col: str = "ts") -> Column:
    return F.col(col) < F.lit(EVENT_CUT).cast("timestamp")


ORDER_IS_OLD_SQL = f"order_ts < TIMESTAMP '{ORDER_CUT} 00:00:00'"
EVENT_IS_OLD_SQL = f"ts < TIMESTAMP '{EVENT_CUT} 00:00:00'"


def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stg_listing as extracted records (record_id = raw_id = seq)."""
    L = staging.stg_listing(spark, sf_dir)
    L = with_source_kind(L, "_kind", platform="platform")
    return (L.withColumn("record_id", F.col("seq"))
            .withColumn("raw_id", F.col("seq"))
            .withColumn("source_kind", F.when(F.expr(MISSING_KIND), F.lit(None)).otherwise(F.col("_kind")))
            .drop("_kind")
            .withColumn("host", url_host("source_url")))


def listing_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ClusterResult]:
    recs = listing_records(spark, sf_dir)
    return recs, cluster_records(recs)


def listing_memberships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, clusters, links) where match scores are not read; the records
    are made once, all three are read from there."""
    recs = stored(listing_records(spark, sf_dir), "records")
    return recs, *memberships(recs)


def word_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, clusters, links): every document is a cluster and each of its
    words, as the text has them between blanks, a record of its own."""
    # a file may be one scan task: documents are dealt out before words are made of them
    docs = staging.table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select(F.col("doc_id").alias("cluster_id"), F.posexplode(F.split("text", " ")).alias("pos", "title"))
    records = words.select((F.col("cluster_id") * (1 << 24) + F.col("pos")).alias("record_id"), "cluster_id", "title",
                           *[F.lit(None).cast("string").alias(c) for c in ("summary", "description", "broker", "source_url")])
    clusters = docs.select(F.col("doc_id").alias("cluster_id"), F.lit("").alias("title"), F.lit(None).cast("string").alias("customer"))
    return records.drop("cluster_id"), clusters, records.select("cluster_id", "record_id")


# ------------------------------------------------------------ source shapes
NOTICE_JSON_KEYS = ("agreement_type", "buyer", "category", "customer", "deadline", "description",
                    "external_id", "id", "notice_id", "notice_type", "published_at", "status",
                    "summary", "title", "url")
# Feed document shape per notice row: a list, an {items: [...]} object, an
# object without items (yields nothing) or a list with non-object entries.
FEED_SHAPE = "seq % 4"
# Truncated (unparseable) feed documents, as a crashed download leaves them.
BAD_FEED = "(line_key div 8) % 50 = 0 AND line_key % 8 = 1"
MAIL_SOURCE = "oppdrag@example.no"
UID_FLOOR = 7500


def notice_json(N: DataFrame) -> Column:
    """One notice as compact JSON (null fields omitted)."""
    return F.to_json(F.struct(*[F.col(k) for k in NOTICE_JSON_KEYS]))


def notice_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source_name, payload): one landed feed document per notice."""
    N = staging.stg_notice(spark, sf_dir).withColumn("bad", F.expr(BAD_FEED))
    js = notice_json(N)
    shape = F.expr(FEED_SHAPE)
    payload = (F.when(F.col("bad"), F.substring(js, 1, 10))
               .when(shape == 0, F.concat(F.lit("["), js, F.lit("]")))
               .when(shape == 1, F.concat(F.lit('{"items":['), js, F.lit("]}")))
               .when(shape == 2, js)
               .otherwise(F.concat(F.lit("["), js, F.lit(', 7, "x"]'))))
    return N.select("seq", "source_name", payload.alias("payload"))


def listing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stg_listing rows as scraped listing documents."""
    L = staging.stg_listing(spark, sf_dir)
    return L.select("seq", F.struct(F.col("title"), F.col("customer").alias("company"),
                                    F.col("summary").alias("description"),
                                    F.col("deadline").alias("delivery_date"),
                                    F.col("source_url").alias("job_uri")).alias("job_overview"),
                    "description", F.col("summary").alias("description_summarised"), "platform")


def with_raw_ids(raw: DataFrame) -> DataFrame:
    from tenderlake.functions.text import content_hash
    return raw.withColumn("raw_id", F.col("seq")).withColumn("content_hash", content_hash("raw_body"))


def version_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """stg_versions as raw-item batches: (stored run, new run)."""
    V = staging.stg_versions(spark, sf_dir)
    raw = V.select("seq", "source_type", "source_name", "external_id", "raw_body",
                   F.lit("{}").alias("metadata"), F.col("ts").alias("received_at"), "ts")
    return raw.where(event_is_old()).drop("ts"), raw.where(~event_is_old()).drop("ts")


# ------------------------------------------------------------ cluster state
VERSION_OFFSET = 1 << 40
NOTICE_VERSION_OFFSET = 1 << 60
# Stored records revised by the batch: those due in 1997.
REVISED = "deadline LIKE '1997%'"
# Reviewer decisions recorded on stored clusters before the batch.
REVIEWED_STATUS = ("CASE WHEN cluster_id % 7 = 3 THEN 'manually_merged' "
                   "WHEN cluster_id % 7 = 5 THEN 'ignored' ELSE review_status END")


@dataclass
class ClusterScenario:
    old_records: DataFrame
    batch_records: DataFrame
    all_records: DataFrame
    failed_raw: DataFrame
    state_clusters: DataFrame
    state_links: DataFrame
    links_after_failures: DataFrame
    failed_affected: DataFrame
    result: ClusterResult


_SCENARIOS: dict[tuple[str, str], ClusterScenario] = {}


def cluster_scenario(spark: SparkSession, sf_dir: str) -> ClusterScenario:
    """The stored state and the batch upon it, built once per session and
    folder: its tables are stored, so later queries read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCENARIOS:
        _SCENARIOS.clear()
        _SCENARIOS[key] = _cluster_scenario(spark, sf_dir)
    return _SCENARIOS[key]


def _cluster_scenario(spark: SparkSession, sf_dir: str) -> ClusterScenario:
    from tenderlake.operators.cluster import detach_records
    # the stored state is what an earlier run wrote: materialize it (in the
    # shared folder), which also keeps the plans of the queries built on this
    # scenario shallow.  Records are made once, with their keys, and read from there.
    recs = stored(with_cluster_key(listing_records(spark, sf_dir)), "records")
    old = recs.where(order_is_old())
    new = recs.where(~order_is_old())
    revised_src = old.where(F.expr(REVISED))
    revised = (revised_src.where(F.col("description").isNotNull())
               .withColumn("record_id", F.col("seq") + F.lit(VERSION_OFFSET))
               .withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" (revised)")))
               .withColumn("deadline", F.concat(F.lit("revised "), F.col("deadline"))))
    revised = stored(with_cluster_key(revised.drop(*KEYED_COLS)), "revised")
    failed = revised_src.where(F.col("description").isNull()).select("raw_id")
    state = cluster_records(old)
    state_clusters = stored(state.clusters.withColumn("review_status", F.expr(REVIEWED_STATUS)), "state_clusters")
    state_links = stored(state.links, "state_links")
    batch = new.unionByName(revised)
    links0, failed_affected = detach_records(state_links, old, failed)
    res = cluster_records(batch, state_clusters, links0, old)
    res.clusters = stored(res.clusters, "clusters")
    res.links = stored(res.links, "links")
    res.touched = res.touched.unionByName(failed_affected).distinct()
    return ClusterScenario(old, batch, old.unionByName(batch), failed, state_clusters, state_links,
                           links0, failed_affected, res)


# ------------------------------------------------------------ digests
SENT_AT = "2024-01-30 10:00:00"
RUN_AS_OF = "2024-02-01 00:00:00"


def synthetic_digests(clusters: DataFrame) -> DataFrame:
    """Digest items left by earlier runs: none / unsent / sent / both,
    by cluster id modulo 4."""
    c = clusters.select("cluster_id", "review_status")
    m = F.col("cluster_id") % 4
    unsent = c.where(m == 1).select((F.col("cluster_id") * 2).alias("digest_id"), "cluster_id", "review_status",
                                    F.lit(None).cast("string").alias("message_ts"),
                                    F.lit(None).cast("timestamp").alias("sent_at"))
    sent = c.where(m.isin(2, 3)).select((F.col("cluster_id") * 2).alias("digest_id"), "cluster_id",
                                        "review_status", F.concat(F.lit("old-"), F.col("cluster_id").cast("string")).alias("message_ts"),
                                        F.lit(SENT_AT).cast("timestamp").alias("sent_at"))
    both = c.where(m == 3).select((F.col("cluster_id") * 2 + 1).alias("digest_id"), "cluster_id", "review_status",
                                  F.lit(None).cast("string").alias("message_ts"),
                                  F.lit(None).cast("timestamp").alias("sent_at"))
    return unsent.unionByName(sent).unionByName(both)


@dataclass
class DigestScenario:
    clusters: ClusterScenario
    scored: DataFrame
    digests: DataFrame
    plan: DataFrame


def digest_scenario(spark: SparkSession, sf_dir: str, policy=None) -> DigestScenario:
    from tenderlake.operators.digest import plan_digest
    from tenderlake.operators.policy import FilterPolicy, include_in_digest, score_clusters
    pol = policy or FilterPolicy.build()
    sc = cluster_scenario(spark, sf_dir)
    res = sc.result
    scored = score_clusters(res.clusters, res.links, sc.all_records, pol)
    digests = synthetic_digests(res.clusters)
    inc = include_in_digest(F.col("review_status"), F.col("confidence"), F.col("relevance_score"), pol)
    plan = plan_digest(scored, digests, inc)
    return DigestScenario(sc, scored, digests, plan)


# ------------------------------------------------------------ signals / gaps
REVISED_NOTICE = "deadline LIKE '1996%'"
GAP_STATUS_SQL = ("CASE first_cluster_id % 5 WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'watch_only' "
                  "WHEN 3 THEN 'ignored' WHEN 4 THEN 'ignored' ELSE 'open' END")
GAP_NOTE_SQL = ("CASE first_cluster_id % 5 WHEN 3 THEN 'not relevant' WHEN 4 THEN "
                "'Auto-closed after matching agreement signal detected for this buyer.' ELSE NULL END")


def notice_raw(spark: SparkSession, sf_dir: str, N: DataFrame | None = None) -> DataFrame:
    """Every staged notice as a raw item, without feed documents around it."""
    from tenderlake.sources.notices import normalize_notices
    N = N if N is not None else staging.stg_notice(spark, sf_dir)
    notices = N.select("seq", "source_name", F.parse_json(notice_json(N)).alias("notice"))
    return with_raw_ids(normalize_notices(notices))


def notice_items(spark: SparkSession, sf_dir: str, N: DataFrame | None = None) -> DataFrame:
    """Raw items as the store has them, without body and metadata: parsed and
    written, so that nothing later is pushed into the parsing."""
    return stored(notice_raw(spark, sf_dir, N).drop("raw_body", "metadata", "content_hash"), "notices")


def order_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source_name, payload): one landed feed document per order and
    source, with all its notices in it."""
    N = staging.stg_notice(spark, sf_dir)
    item = F.struct("seq", notice_json(N).alias("js"))
    return (N.withColumn("_item", item).groupBy(F.expr("line_key div 8").alias("seq"), "source_name")
            .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
            .select("seq", "source_name", F.concat(F.lit("["), F.array_join(
                F.transform("_items", lambda x: x["js"]), ","), F.lit("]")).alias("payload")))


def flagged_notices(spark: SparkSession, sf_dir: str, *cols: str, N: DataFrame | None = None) -> DataFrame:
    """Every staged notice as detection leaves it: key, order, ``detected`` and
    the signal columns named.  Written, so that nothing later is pushed into the
    parsing; what nobody reads of a notice is neither written nor sorted."""
    from tenderlake.operators.signals import SIGNAL_KEY, detect_signals
    cols = list(dict.fromkeys([*SIGNAL_KEY, "seq", "detected", *cols]))
    return stored(detect_signals(notice_raw(spark, sf_dir, N)).select(*cols), "flagged")


def all_signals(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    from tenderlake.operators.signals import sync_signals
    return sync_signals(None, flagged_notices(spark, sf_dir, *cols))


def signal_scenario(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    from tenderlake.operators.signals import sync_signals
    N = staging.stg_notice(spark, sf_dir)
    old = N.where(order_is_old())
    revised = (old.where(F.expr(REVISED_NOTICE))
               .withColumn("seq", F.col("seq") + F.lit(NOTICE_VERSION_OFFSET))
               .withColumn("title", F.lit("Open competition"))
               .withColumn("agreement_type", F.lit(None).cast("string"))
               .withColumn("notice_type", F.lit(None).cast("string")))
    batch = N.where(~order_is_old()).unionByName(revised)
    state = sync_signals(None, flagged_notices(spark, sf_dir, *cols, N=old))
    return sync_signals(state, flagged_notices(spark, sf_dir, *cols, N=batch))


def gap_scenario(spark: SparkSession, sf_dir: str):
    from tenderlake.operators.gaps import discover_gaps
    sc = cluster_scenario(spark, sf_dir)
    # read several times: for the buyers covered, and to be counted
    signals = stored(all_signals(spark, sf_dir, "buyer_name"), "signals")
    old = discover_gaps(sc.state_clusters, sc.state_links, signals.limit(0)).gaps
    old = old.withColumn("status", F.expr(GAP_STATUS_SQL)).withColumn("note", F.expr(GAP_NOTE_SQL))
    return sc, signals, discover_gaps(sc.result.clusters, sc.result.links, signals, state=old)
