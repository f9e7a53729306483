"""Plans and results of the notice, signal and error paths."""

import re

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _notices(spark, texts):
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "seq int, source_name string, js string")
    return rows.select("seq", "source_name", F.expr("parse_json(js)").alias("notice"))


def test_signals_move_only_the_columns_that_are_read(spark):
    """A reader of buyers sorts no other column."""
    from tenderlake.operators.signals import detect_signals, sync_signals
    from tenderlake.sources.notices import normalize_notices
    raw = normalize_notices(_notices(spark, ['{"title":"DPS","buyer":"b","id":"1","deadline":"d"}'])).withColumn("raw_id", F.col("seq"))
    flagged = detect_signals(raw)
    buyers = sync_signals(None, flagged).select("source_name", "external_id", "buyer_name")
    plan = _plan(buyers)
    assert "max_by(buyer_name" in plan and "max_by(seq" not in plan and "max_by(named_struct" not in plan
    assert [tuple(r) for r in buyers.collect()] == [("s", "1", "b")]
    few = sync_signals(None, flagged.select("source_name", "external_id", "seq", "detected", "buyer_name"))
    assert sorted(few.columns) == ["buyer_name", "external_id", "seq", "source_name", "updated_at"]
    assert [tuple(r) for r in few.select(buyers.columns).collect()] == [("s", "1", "b")]


def test_sync_takes_all_columns_from_the_newest_row(spark):
    from tenderlake.operators.signals import SIGNAL_COLS, sync_signals
    cols = [c for c in SIGNAL_COLS if c not in ("seq", "updated_at", "source_name", "external_id")]
    names = ["source_name", "external_id", "seq", "detected", *cols]
    types = "source_name string, external_id string, seq long, detected boolean, " + ", ".join(f"{c} string" for c in cols)

    def rows(*rs):
        data = [(s, e, q, d, *[None if q % 2 else f"{c}{q}" for c in cols]) for s, e, q, d in rs]
        return spark.createDataFrame(data, types).select(*names)
    state = sync_signals(None, rows(("a", "k", 2, True), ("a", "k", 1, True), ("b", "k", 4, False), ("c", "k", 6, True), (None, "k", 8, True)))
    got = {r["source_name"]: r for r in state.collect()}
    assert set(got) == {"a", "c", None} and got["a"]["seq"] == 2 and got["a"]["title"] == "title2"
    both = sync_signals(state, rows(("a", "k", 3, True), ("c", "k", 8, False), (None, "k", 10, True)))
    left = sorted((r["source_name"] or "", r["seq"], r["title"]) for r in both.collect())
    # the newest row's nulls stand too; a null key meets no stored one
    assert left == [("", 8, "title8"), ("", 10, "title10"), ("a", 3, None)]


def test_feed_entries_that_are_objects_are_told_by_type(spark):
    from tenderlake.sources.notices import explode_feed
    feed = spark.createDataFrame([('[{}, {"a":1}, 7, "x", null, [1], true, {"OBJECT<":[{}]}]',)], "payload string")
    out = explode_feed(feed)
    assert [r[0] for r in out.orderBy("notice_pos").select("notice_pos").collect()] == [0, 1, 7]
    assert "MapType" not in _plan(out)


def test_odd_keys_and_types_take_the_long_way(spark):
    """Colons, blanks and type names in keys and values do not pass for texts."""
    from tenderlake.sources.notices import _with_texts
    texts = ['{"a":"x: BIGINT","b":null}', '{"a: STRING":1}', '{"a":{"b":"x"}}', '{"STRING":"x"}', '{"a":1}', '[]', '{}', '"OBJECT<"']
    got = [r[0] for r in _with_texts(_notices(spark, texts), "notice").orderBy("seq").select("_texts").collect()]
    assert got == [True, False, False, True, False, False, True, False]


def test_detection_agrees_with_the_bare_pattern(spark):
    from tenderlake.functions.kinds import AGREEMENT_REGEX, phrase_in_any
    texts = ["dps", "dpsx", "a dps", "framework agreement", "frameworks", "ramme-avtale", "rammeavtaler", "", None, "dynamic purchasing system", "xédps"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(phrase_in_any(F.col("t"), F.lit("zz")).alias("a"), F.concat_ws("\n", "t", F.lit("zz")).rlike(AGREEMENT_REGEX).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a for r in got) == 5


def test_items_that_did_not_fail_are_not_made_again(spark, tmp_path):
    """the ids of failed items reach the staged rows before items are made."""
    import datetime as dt
    from tenderlake.plans import catalog
    ts = dt.datetime(1997, 1, 1)
    t = {"nation": spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
         "customer": spark.createDataFrame([(1, "c", 1, 1.0, "B")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
         "supplier": spark.createDataFrame([(1, "s", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
         "orders": spark.createDataFrame([(i, 1, "P" if i % 2 else "F", 1.0, ts, "1-URGENT") for i in range(1, 7)],
                                         "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
         "lineitem": spark.createDataFrame([(i, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", ts) for i in range(1, 7)],
                                           "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for n, df in t.items():
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    out = catalog.QUERIES["extract_errors"](spark, str(tmp_path))
    indent = lambda x: len(x) - len(x.lstrip(" :+-"))
    lines = _plan(out).split("\n")
    at = [i for i, x in enumerate(lines) if "parseJson" in x]
    assert at and all(any("LeftSemi" in y and indent(y) > indent(lines[i]) for y in lines[i:]) for i in at)
    assert sorted(r.raw_id for r in out.collect()) == [5, 13, 21]
