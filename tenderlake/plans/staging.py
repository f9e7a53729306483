"""Staging: the driver's tables reshaped into the pipeline's input shapes.

The derivations are deterministic functions of key columns, written once as
SQL expression text that both Spark (``selectExpr``) and DuckDB accept, so
the oracle sees exactly the same inputs.  Every staging view keeps all rows
of its source tables; the key-derived CASE branches only vary field values
(noise, missing fields), they never drop rows.

Views
-----
``stg_listing``  orders ⋈ customer ⋈ nation — one extracted-record-shaped row
                 per order (``seq`` = order key).
``stg_versions`` events — raw items keyed by (event_type, user_id); body =
                 props; arrival order = (ts, event_id).
``stg_mail``     text mail built around ``stg_listing`` rows.
``stg_notice``   lineitem ⋈ orders ⋈ supplier ⋈ nation — procurement notices.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- listings
_ROLE_PHRASE = """CASE o_orderkey % 9
  WHEN 0 THEN 'Senior Data Engineer'
  WHEN 1 THEN 'Backend Python developer'
  WHEN 2 THEN 'React frontend'
  WHEN 3 THEN 'Kubernetes platform engineer'
  WHEN 4 THEN 'Security IAM advisor'
  WHEN 5 THEN 'Project manager'
  WHEN 6 THEN 'QA test automation'
  WHEN 7 THEN 'JavaScript developer'
  ELSE 'Consultant' END"""

_SKILL_PHRASE = """CASE o_custkey % 11
  WHEN 0 THEN 'airflow and dbt pipeline work'
  WHEN 1 THEN 'java spring microservice'
  WHEN 2 THEN 'typescript and vue'
  WHEN 3 THEN 'terraform on azure'
  WHEN 4 THEN 'zero trust and siem'
  WHEN 5 THEN 'scrum master duties'
  WHEN 6 THEN 'selenium and cypress'
  WHEN 7 THEN 'javascript only'
  WHEN 8 THEN 'data platform on databricks'
  WHEN 9 THEN 'ci/cd with gcp'
  ELSE 'general advisory' END"""

_SOURCE_TYPE = "CASE o_orderkey % 4 WHEN 0 THEN 'email' WHEN 3 THEN 'procurement' ELSE 'scraper' END"
_SOURCE_NAME = """CASE o_orderkey % 7
  WHEN 0 THEN 'Doffin'
  WHEN 1 THEN 'forward-talent'
  WHEN 2 THEN 'Mercell'
  WHEN 3 THEN 'Verama'
  WHEN 4 THEN 'Witted'
  WHEN 5 THEN 'anskaffelser'
  ELSE 'direct-client' END"""

LISTING_EXPRS: list[tuple[str, str]] = [
    ("seq", "o_orderkey"),
    ("custkey", "o_custkey"),
    ("source_type", _SOURCE_TYPE),
    ("source_name", _SOURCE_NAME),
    ("external_id", "'o-' || CAST(o_orderkey AS STRING)"),
    ("title", f"""CASE WHEN o_orderkey % 13 = 0 THEN NULL
      WHEN o_orderkey % 13 = 1 THEN ''
      ELSE {_ROLE_PHRASE} || ' ' || lower(c_mktsegment) || ' ' || substr(o_orderpriority, 3) END"""),
    ("customer", """CASE WHEN o_orderkey % 17 = 0 THEN NULL
      WHEN o_orderkey % 3 = 0 THEN n_name
      WHEN o_orderkey % 3 = 1 THEN upper(n_name) || '  '
      ELSE ' ' || lower(n_name) END"""),
    ("broker", f"""CASE WHEN o_orderkey % 4 = 0
      THEN 'sales' || CAST(o_custkey % 10 AS STRING) || '@mail.example.no'
      ELSE {_SOURCE_NAME} END"""),
    ("source_url", """CASE WHEN o_orderkey % 5 = 0 THEN NULL
      ELSE 'https://Example.com/o/' || CAST(o_custkey AS STRING)
           || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END END"""),
    ("deadline", """CASE WHEN o_orderkey % 11 = 0 THEN NULL
      ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"""),
    ("description", f"""CASE WHEN o_orderstatus = 'P' THEN NULL
      ELSE 'Need ' || {_SKILL_PHRASE} || ' for ' || c_name || '. Status ' || o_orderstatus END"""),
    ("summary", "CASE WHEN o_orderkey % 6 = 0 THEN 'python api backend' ELSE NULL END"),
    ("platform", f"CASE WHEN o_orderkey % 4 IN (1, 2) THEN {_SOURCE_NAME} ELSE NULL END"),
    ("extraction_confidence", """CASE o_orderkey % 4 WHEN 0 THEN CAST(0.65 AS DOUBLE)
      WHEN 3 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END"""),
    ("order_ts", "o_orderdate"),
    ("order_status", "o_orderstatus"),
]

LISTING_FROM = ("orders JOIN customer ON o_custkey = c_custkey "
                "JOIN nation ON c_nationkey = n_nationkey")


def stg_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders are few bytes a row: a file may be one scan task with a million rows
    orders = table(spark, sf_dir, "orders").repartition("o_orderkey")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in LISTING_EXPRS])


# ---------------------------------------------------------------- versions
VERSION_EXPRS: list[tuple[str, str]] = [
    ("source_type", "'event'"),
    ("source_name", "event_type"),
    ("external_id", "CAST(user_id AS STRING)"),
    ("seq", "event_id"),
    ("ts", "ts"),
    ("raw_body", "props"),
]


def stg_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in VERSION_EXPRS])


# ---------------------------------------------------------------- mail
# Mail built around listing rows: a subject with or without the title marker,
# a body with a deadline line, a link that ends in ')' and CRLF line breaks.
MAIL_EXPRS: list[tuple[str, str]] = [
    ("uid", "seq"),
    ("message_id", "CASE WHEN seq % 8 = 0 THEN NULL ELSE '<m' || CAST(seq AS STRING) || '@mail.example.no>' END"),
    ("subject", """CASE seq % 3
      WHEN 0 THEN 'Oppdrag: ' || coalesce(title, '')
      WHEN 1 THEN 'Fwd: ' || coalesce(customer, 'request')
      ELSE 'Assignment- ' || coalesce(title, 'unknown') END"""),
    ("sender", "coalesce(broker, 'unknown@mail.example.no')"),
    ("body", """'Hei,' || CASE WHEN seq % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END
      || CASE WHEN seq % 3 = 1 THEN 'Rolle: ' || coalesce(title, '') || chr(10) ELSE '' END
      || CASE WHEN seq % 5 = 2 THEN '' ELSE 'Frist: ' || coalesce(deadline, 'snarest') || chr(10) END
      || 'Les mer (' || coalesce(source_url, 'ingen lenke') || ') ' || chr(10)
      || coalesce(description, '')"""),
]


def stg_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stg_listing(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in MAIL_EXPRS])


# ---------------------------------------------------------------- notices
_NOTICE_SOURCE = """CASE l_suppkey % 3 WHEN 0 THEN 'doffin'
  WHEN 1 THEN 'mercell-tender' ELSE 'kgv-portal' END"""
_NID = "'n-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"

NOTICE_EXPRS: list[tuple[str, str]] = [
    # (l_orderkey, l_linenumber) repeats in the driver's lineitem; with the
    # part and supplier keys it is unique (part keys < 2^20, supplier keys
    # < 2^12 at the test scales).
    ("seq", "((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 4096 + l_suppkey"),
    ("line_key", "l_orderkey * 8 + l_linenumber"),
    ("source_name", _NOTICE_SOURCE),
    ("id", f"CASE WHEN l_linenumber IN (1, 2, 3) THEN {_NID} WHEN l_linenumber = 4 THEN '' ELSE NULL END"),
    ("notice_id", f"CASE WHEN l_linenumber = 5 THEN 'notice-' || {_NID} ELSE NULL END"),
    ("external_id", f"CASE WHEN l_linenumber = 6 THEN 'ext-' || {_NID} ELSE NULL END"),
    ("url", f"""CASE WHEN l_linenumber = 2 THEN NULL
      ELSE 'https://tenders.example.org/' || {_NOTICE_SOURCE} || '/' || CAST(l_orderkey AS STRING) END"""),
    ("title", """CASE l_partkey % 8
      WHEN 0 THEN 'Rammeavtale IT-konsulenter'
      WHEN 1 THEN 'DPS for cloud services'
      WHEN 2 THEN 'Framework agreement data platform'
      WHEN 3 THEN 'Test frameworks for QA'
      WHEN 4 THEN 'ramme-avtale konsulent'
      WHEN 5 THEN 'Backend developer'
      WHEN 6 THEN ''
      ELSE NULL END"""),
    ("buyer", """CASE WHEN l_linenumber = 3 THEN NULL
      WHEN s_nationkey % 3 = 0 THEN
        CASE l_orderkey % 3 WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) ELSE ' ' || lower(n_name) || ' ' END
      ELSE CASE l_orderkey % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE ' ' || lower(s_name) || ' ' END END"""),
    ("customer", "CASE WHEN l_linenumber = 3 THEN s_name ELSE NULL END"),
    ("agreement_type", """CASE l_partkey % 6
      WHEN 0 THEN 'DPS' WHEN 1 THEN 'frame' WHEN 2 THEN ''
      WHEN 3 THEN NULL WHEN 4 THEN 'Open procedure' ELSE 'Ramme  avtale' END"""),
    ("notice_type", """CASE l_orderkey % 5
      WHEN 0 THEN 'Contract notice' WHEN 1 THEN 'prior information'
      WHEN 2 THEN 'Dynamic Purchasing System' WHEN 3 THEN NULL ELSE '' END"""),
    ("category", "CASE l_partkey % 3 WHEN 0 THEN 'IT' WHEN 1 THEN 'Consulting' ELSE NULL END"),
    ("status", "CASE WHEN l_linestatus = 'O' THEN ' Open ' ELSE 'CLOSED' END"),
    ("deadline", "CAST(CAST(l_shipdate AS DATE) AS STRING)"),
    ("published_at", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
    ("description", "CASE WHEN l_linenumber % 2 = 0 THEN 'Scope ' || l_returnflag || ' quantity ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) ELSE NULL END"),
    ("summary", "CASE WHEN l_linenumber = 1 THEN 'spark etl pipeline' ELSE NULL END"),
    ("order_ts", "o_orderdate"),
]

NOTICE_FROM = ("lineitem JOIN orders ON l_orderkey = o_orderkey "
               "JOIN supplier ON l_suppkey = s_suppkey "
               "JOIN nation ON s_nationkey = n_nationkey")


def stg_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out before texts are made of them, by the key they are joined on
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    # supplier and nation are dimension tables (rows grow with sf only
    # through supplier, ~1/600 of lineitem); AQE broadcasts them when small.
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in NOTICE_EXPRS])


# ---------------------------------------------------------------- SQL text
def _sql_select(exprs: list[tuple[str, str]]) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in exprs)


def listing_sql() -> str:
    return f"SELECT {_sql_select(LISTING_EXPRS)} FROM {LISTING_FROM}"


def versions_sql() -> str:
    return f"SELECT {_sql_select(VERSION_EXPRS)} FROM events"


def mail_sql() -> str:
    return f"SELECT {_sql_select(MAIL_EXPRS)} FROM stg_listing"


def notice_sql() -> str:
    return f"SELECT {_sql_select(NOTICE_EXPRS)} FROM {NOTICE_FROM}"


STAGING_SQL = {
    "stg_listing": listing_sql,
    "stg_versions": versions_sql,
    "stg_mail": mail_sql,
    "stg_notice": notice_sql,
}
STAGING_DEPS = {"stg_mail": ["stg_listing"]}


def with_staging(sql_body: str, *views: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix an oracle query with the staging CTEs it needs."""
    order: list[str] = []
    for v in views:
        for d in STAGING_DEPS.get(v, []):
            if d not in order:
                order.append(d)
        if v not in order:
            order.append(v)
    ctes = [(v, STAGING_SQL[v]()) for v in order] + list(extra_ctes or [])
    if not ctes:
        return sql_body
    text = "\n".join([s for _, s in ctes] + [sql_body])

    def kept(name: str) -> str:
        # what several places read is computed once
        return "MATERIALIZED " if len(re.findall(rf"\b{name}\b", text)) > 1 else ""
    return "WITH " + ",\n".join(f"{n} AS {kept(n)}(\n{s}\n)" for n, s in ctes) + "\n" + sql_body
