"""Explicit schemas of the stored state tables, and schema backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()

CLUSTER_SCHEMA = T.StructType([
    T.StructField("cluster_id", L), T.StructField("cluster_key", S), T.StructField("title", S),
    T.StructField("customer", S), T.StructField("primary_record_id", L),
    T.StructField("review_status", S), T.StructField("confidence", D),
    T.StructField("role_category", S), T.StructField("role_tags", T.ArrayType(S)),
    T.StructField("relevance_score", D), T.StructField("relevance_rationale", S),
])
LINK_SCHEMA = T.StructType([T.StructField("cluster_id", L), T.StructField("record_id", L),
                            T.StructField("match_confidence", D), T.StructField("match_rationale", S)])
GAP_SCHEMA = T.StructType([T.StructField("gap_key", S), T.StructField("buyer_name", S),
                           T.StructField("status", S), T.StructField("confidence", D),
                           T.StructField("rationale", S), T.StructField("cluster_count", L),
                           T.StructField("first_cluster_id", L), T.StructField("note", S)])

# Defaults for columns added after rows were first written.
def default_values() -> dict:
    return {"role_tags": F.array().cast("array<string>"), "relevance_score": F.lit(0.0)}


def align_to_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add missing columns (default or null), cast present ones, keep the
    schema's column order.  A projection only — no data movement."""
    dflt = default_values()
    dflt.update(defaults or {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in dflt:
                c = F.coalesce(c, dflt[f.name].cast(f.dataType))
        else:
            c = dflt.get(f.name, F.lit(None)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)
