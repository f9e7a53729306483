"""Market analytics (K1–K4) and review transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import fixed


def buyer_trends(clusters: DataFrame, limit: int = fixed.TREND_LIMIT) -> DataFrame:
    """K1: clusters per raw customer name with mean confidence, top k."""
    return (clusters.where(F.col("customer").isNotNull()).groupBy(F.col("customer").alias("buyer"))
            .agg(F.count(F.lit(1)).alias("opportunity_count"), F.avg("confidence").alias("avg_confidence"))
            .orderBy(F.col("opportunity_count").desc(), F.col("buyer")).limit(limit))


def broker_patterns(records: DataFrame, limit: int = fixed.TREND_LIMIT) -> DataFrame:
    """K2: records and exact distinct buyers per broker, top k."""
    return (records.where(F.col("broker").isNotNull()).groupBy("broker")
            .agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("customer").alias("unique_buyers"))
            .orderBy(F.col("record_count").desc(), F.col("broker")).limit(limit))


def source_quality(clusters: DataFrame, links: DataFrame, comparisons: DataFrame) -> DataFrame:
    """K3: one row — cluster count, clusters with conflicts, their ratio and
    the mean number of sources over clusters that have sources."""
    n = clusters.agg(F.count(F.lit(1)).alias("cluster_count"))
    c = comparisons.agg(F.countDistinct("cluster_id").alias("clusters_with_conflicts"))
    per = links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k"))
    a = per.agg(F.coalesce(F.avg("k"), F.lit(0.0)).alias("average_sources_per_cluster"))
    return (n.crossJoin(c).crossJoin(a)   # three one-row aggregates
            .withColumn("conflict_ratio",
                        F.when(F.col("cluster_count") > 0,
                               F.col("clusters_with_conflicts") / F.col("cluster_count")).otherwise(F.lit(0.0))))


def coverage_summary(signals: DataFrame, gaps: DataFrame) -> DataFrame:
    """K4: one row — signal, gap and open-gap counts."""
    s = signals.agg(F.count(F.lit(1)).alias("agreement_signal_count"))
    g = gaps.agg(F.count(F.lit(1)).alias("gap_count"),
                 F.count_if(F.col("status") == "open").alias("open_gap_count"))
    return s.crossJoin(g)


def market_summary(trends: DataFrame, brokers: DataFrame, quality: DataFrame,
                   coverage: DataFrame) -> DataFrame:
    """K5: the four reports in one long table (section, name, metric, value):
    top buyers, top brokers, source quality and coverage."""
    def long(df: DataFrame, section: str, name, metrics: list[str]) -> DataFrame:
        pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
        return df.select(F.lit(section).alias("section"), name.alias("name"),
                         F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))
    whole = F.lit("all")
    return (long(trends, "buyer_trends", F.col("buyer"), ["opportunity_count", "avg_confidence"])
            .unionByName(long(brokers, "broker_patterns", F.col("broker"), ["record_count", "unique_buyers"]))
            .unionByName(long(quality, "source_quality", whole, [
                "cluster_count", "clusters_with_conflicts", "conflict_ratio", "average_sources_per_cluster"]))
            .unionByName(long(coverage, "coverage", whole, [
                "agreement_signal_count", "gap_count", "open_gap_count"])))


def apply_review(clusters: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append transitions to the history; current status = newest
    transition per cluster.  Returns (clusters, history rows, rejected:
    unknown clusters and statuses)."""
    valid = F.coalesce(F.col("status").isin(*fixed.REVIEW_STATUSES), F.lit(False))
    known = transitions.where(valid).join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    rejected = transitions.where(~valid).unionByName(
        transitions.where(valid).join(clusters.select("cluster_id"), "cluster_id", "left_anti")
        .select(*transitions.columns))
    cur = known.groupBy("cluster_id").agg(F.max_by("status", "seq").alias("_new"),
                                          F.count(F.lit(1)).alias("n_transitions"))
    out = (clusters.join(cur, "cluster_id", "left")
           .withColumn("review_status", F.coalesce("_new", "review_status")).drop("_new"))
    return out, known, rejected
