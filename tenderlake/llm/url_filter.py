"""URL filters by a temporal list join.

A list is a log of dated entries: a pattern (a domain, or a host with the
beginning of a path), block or allow, added or removed on a date.  The log
becomes validity intervals, and each capture is judged by the entries active
when it was fetched: the most specific active pattern decides (a path before a
host, more labels or segments before fewer), allow before block where both
hold.

A capture is looked up by its keys: its host and parent domains, and its host
with each beginning of its path.  Keys are first reduced to distinct (key,
time) points, which meet the intervals in an as-of join; verdicts return to
the captures by (key, time).  A host with a third of all captures thus meets
the list once a point in time, and its captures are spread by time.

Defined cases: a null or malformed URL has no host and is never blocked; a
null time is before every entry; entries with a null pattern or date are
ignored; of entries of one pattern, kind and date the removal holds; removing
what isn't listed changes nothing; repeated captures are judged each; empty
tables give empty results or no block; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import fresh, saved

BLOCK, ALLOW, ADD, REMOVE = "block", "allow", "add", "remove"


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """Array of (key, level): parent domains get the number of labels, path
    beginnings 1,000 and the number of segments more than any host."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.array_join(F.slice(labels, -i, i), ".").alias("key"), i.alias("level")))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"),
        (i + 1000).alias("level"))))
    none = F.array().cast("array<struct<key:string,level:int>>")
    return F.when(host(url) != "", F.concat(domains, F.coalesce(paths, none))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """key, kind, listed_from and listed_to (exclusive; null: still listed) of
    a log with the columns pattern, kind, action, dated."""
    day = (entries.where(F.col("pattern").isNotNull() & F.col("dated").isNotNull())
           .groupBy(F.col("pattern").alias("key"), "kind", "dated")
           .agg(F.bool_and(F.col("action") == ADD).alias("on")))
    w = Window.partitionBy("key", "kind").orderBy("dated")
    # only changes of state open or close an interval
    change = (day.withColumn("was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("was")))
    return (change.withColumn("listed_to", F.lead("dated").over(w)).where("on")
            .select("key", "kind", F.col("dated").alias("listed_from"), "listed_to"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``rule`` (the deciding pattern),
    ``listed_from`` and ``n_active`` (active entries that match)."""
    n = fresh(captures, "row", "blocked", "rule", "listed_from", "n_active")
    rows = saved(captures.select("*", F.monotonically_increasing_id().alias(n["row"])), "url-captures")
    found = rows.select(F.col(n["row"]).alias("row"), F.col(time_col).alias("t"),
                        F.inline(keys(F.col(url_col)))).where(F.col("t").isNotNull())
    points = found.select("key", "t").distinct()
    valid = intervals(entries)
    active = (points.join(valid, "key")
              .where((F.col("listed_from") <= F.col("t")) & (F.col("listed_to").isNull() | (F.col("t") < F.col("listed_to"))))
              .groupBy("key", "t").agg(
                  F.min(F.struct("kind", "listed_from")).alias("best"),   # allow sorts before block
                  F.count(F.lit(1)).alias("n")))
    verdict = found.join(active, ["key", "t"]).groupBy("row").agg(
        F.max_by(F.struct("key", "best"), F.struct("level", "key")).alias("v"), F.sum("n").alias("n"))
    return (rows.join(verdict.withColumnRenamed("row", n["row"]), n["row"], "left")
            .select(*[F.col(f"`{c}`") for c in captures.columns],
                    F.coalesce(F.col("v.best.kind") == BLOCK, F.lit(False)).alias(n["blocked"]),
                    F.col("v.key").alias(n["rule"]), F.col("v.best.listed_from").alias(n["listed_from"]),
                    F.coalesce("n", F.lit(0)).cast("long").alias(n["n_active"])))
