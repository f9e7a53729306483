"""Queries that must spread their work and not do it twice (round 3)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F


def _tables(spark, orders: int, lines: int = 2) -> str:
    """A folder with orders, customer, supplier, nation and lineitem, one file each."""
    d = tempfile.mkdtemp(prefix="tenderlake-r3-", dir="/tmp")

    def put(df, name):
        df.coalesce(1).write.parquet(os.path.join(d, f"{name}.parquet"))
    put(spark.range(25).selectExpr("id AS n_nationkey", "concat('NATION_', id) AS n_name"), "nation")
    put(spark.range(20).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "id % 25 AS c_nationkey",
                                   "'BUILDING' AS c_mktsegment"), "customer")
    put(spark.range(7).selectExpr("id AS s_suppkey", "concat('Supplier ', id) AS s_name", "id AS s_nationkey"), "supplier")
    put(spark.range(orders).selectExpr(
        "id AS o_orderkey", "id % 20 AS o_custkey", "element_at(array('F', 'O', 'P'), cast(id % 3 + 1 as int)) AS o_orderstatus",
        "date_add(DATE'1995-01-01', cast(id * 37 % 2000 as int)) AS _d", "'1-URGENT' AS o_orderpriority")
        .withColumn("o_orderdate", F.col("_d").cast("timestamp")).drop("_d"), "orders")
    put(spark.range(orders * lines).selectExpr(
        f"id div {lines} AS l_orderkey", f"id % {lines} + 1 AS l_linenumber", "id % 31 AS l_partkey", "id % 7 AS l_suppkey",
        "'O' AS l_linestatus", "'N' AS l_returnflag", "cast(3 as double) AS l_quantity",
        "timestamp'1996-03-01 00:00:00' AS l_shipdate"), "lineitem")
    return d


def test_mail_is_decoded_by_many_tasks(spark):
    from tenderlake.plans.catalog import QUERIES
    got = QUERIES["mail_decode"](spark, _tables(spark, 400))
    assert got.count() == 400 and got.where("_error IS NOT NULL OR uid IS NULL").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("RepartitionByExpression")


def test_headers_read_as_the_policy_reads_them():
    from email import message_from_bytes, policy

    from tenderlake.sources import mail as M
    heads = [("Subject", v) for v in ("Plain  text; (a) \"b\"", "=?utf-8?q?caf=C3=A9?= x", "a =?b", "", "café", "a\r\n  folded")]
    heads += [("From", v) for v in ("a.b@c.example", "Jo <a@b.example>", "no-address", "a@b, c@d.example", "=?utf-8?q?=C3=A9?= <a@b>",
                                    "a..b@c", "(x) a@b", "a@[1.2.3.4]", "=?x@y?=")]
    heads += [("Message-ID", v) for v in ("<a.b@c>", "a@b", "<a b@c>", "<a@b> x", "<a..b@c>", "<=?a@b?=>")]
    for name, value in heads:
        raw = f"{name}: {value}\r\nContent-Type: text/plain; charset=latin-1\r\n\r\nblå".encode("latin-1")
        want = message_from_bytes(raw, policy=policy.default)
        key = {"Subject": "subject", "From": "sender", "Message-ID": "message_id"}[name]
        got = M._read_message(raw)
        assert got[key] == str(want[name] or "") and got["body"] == "blå", (name, value)


def test_a_repeated_header_value_is_parsed_once():
    from tenderlake.sources import mail as M
    raw = b"From: a@b.example\r\nSubject: x\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody"
    M._read_message(raw)
    before = M._parsed.cache_info().misses
    for _ in range(50):
        M._read_message(raw)
    assert M._parsed.cache_info().misses == before


def test_notices_of_texts_and_of_other_types_read_alike(spark):
    """A notice of texts only takes the short way; its twin with one number more
    takes the long one: body, key and typed fields must agree."""
    from tenderlake.sources import notices as N
    texts = ['{"id":"0","title":"R\\u00e9 \\\\"x\\\\"\\u2028","buyer":"","customer":"c","url":null,"Zz":"q"}',
             '{"title":"","url":"u","agreement_type":" DPS ","notice_type":"0"}', '{}', '{"a b":"x","id":"k"}',
             '{"title":0,"buyer":false,"id":7}', '{"title":{"a":[1]},"id":null}']
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "seq int, source_name string, js string")
    rows = rows.withColumn("js", F.expr("replace(js, '\\\\\\\\', '\\\\')"))
    got = N.normalize_notices(rows.select("seq", "source_name", F.expr("parse_json(js)").alias("notice")))
    odd = N.normalize_notices(rows.select("seq", "source_name", F.expr(
        "parse_json(concat(left(js, length(js) - 1), if(js = '{}', '', ','), '\"zzz\":1}'))").alias("notice")))
    a = {r["seq"]: r for r in got.collect()}
    b = {r["seq"]: r for r in odd.collect()}
    assert len(a) == len(b) == len(texts)
    for i in a:
        assert a[i]["notice"] == b[i]["notice"]
        assert b[i]["raw_body"] == a[i]["raw_body"][:-1] + ("" if a[i]["raw_body"] == "{}" else ",") + '"zzz":1}'
    assert a[0]["external_id"] == "0" and a[0]["notice"]["customer"] == "c" and a[0]["notice"]["title"].startswith("Ré ")
    assert a[1]["notice"]["told_notice_type"] == "0" and a[1]["external_id"] == "u" and a[1]["notice"]["title"] == ""
    assert a[4]["external_id"] == "7" and a[4]["notice"]["own_title"] is None and a[4]["notice"]["title"] == "0"


def test_notice_reads_its_texts_once(spark):
    """Every further look into the VARIANT costs as much as the first."""
    from tenderlake.sources import notices as N
    rows = spark.createDataFrame([(1, "s", "{}")], "seq int, source_name string, js string")
    raw = N.normalize_notices(rows.select("seq", "source_name", F.expr("parse_json(js)").alias("notice")))
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "_texts#" in plan
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
