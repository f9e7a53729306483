"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they
belong to).  Each pattern's token capacity is routed to the quotas of its
sources; a second and a third pass over a pattern cost more than the first
(convex repetition costs), so nothing repeats while a fresh token can serve
the same quota.  The flow lives on patterns and sources only, its size does
not grow with the documents.  Documents are then selected by a seeded hash
order: whole passes over the pattern, plus the shortest prefix of that order
that comes nearest to the rest.  The prefix sums run over 4,096 hash ranges
per pattern first and over rows only inside the one range that is cut, so a
source holding a third of all rows is no single task.

Defined cases: a null text has size 0; a null source is a source of its own;
documents of size 0 take 0 words; repeated rows are documents of their own;
an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import WORD, fresh, saved

MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)
SEED = 20240617
RANGE_BITS = 12
MAX_PATTERNS = 100_000   # refused beyond, never cut: the flow is solved on the driver


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: list[int], weights: list[float], most: float = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight; a share stops at ``most`` times its size
    and what is over goes to the others by weight."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int],
                  repeat: int = MAX_REPEAT) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each of its sources.

    Arcs: start -> pattern once per pass (costs 0, 1, 2, ... a token),
    pattern -> its sources, source -> end up to its quota.  Successive
    shortest paths, with a queue-based search as residual costs may be
    negative."""
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    arcs: list[list[int]] = []           # to, room, cost
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    for p, c in enumerate(capacity):
        for k in range(repeat):
            arc(start, p, c, k)
    routes = [{s: arc(p, n_p + s, repeat * capacity[p], 0) for s in members[p]} for p in range(n_p)]
    for s, q in enumerate(quota):
        arc(n_p + s, end, q, 0)
    while True:
        far, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                b, room, cost = arcs[e]
                if room > 0 and far[a] + cost < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost, e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if end not in far:
            break
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
    return [{s: arcs[e ^ 1][1] for s, e in r.items()} for r in routes]


def mix(docs: DataFrame, memberships: Column, size: Column, order_id: Column,
        weights: tuple[float, ...] = WEIGHTS, repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``sources`` (sorted membership array), ``copies``
    and ``taken`` (= copies * size), and per pattern ``routed``: the tokens of
    the pattern and, per source, (source, source_size, target, tokens).

    ``memberships`` is an array of source names (a null element is a source,
    sorted last); weights repeat over the sources by code point.  Rows without
    any source are never taken.  Where ``docs`` has a column of such a name, the
    new one gets underscores in front."""
    spark = docs.sparkSession
    mine = docs.columns
    n = fresh(docs, "size", "sources", "copies", "taken", "routed")
    base = saved(docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(mine)], F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.coalesce(F.array_sort(F.array_distinct(memberships)), F.array().cast("array<string>")).alias("_in"), order_id.alias("_key"),
        F.monotonically_increasing_id().alias("_row"))
        .withColumn("_hash", F.xxhash64(F.lit(seed), "_key"))
        .withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGE_BITS)), "mix-base")
    ranges = saved(base.groupBy("_in", "_range").agg(F.sum("_size").alias("_sum")), "mix-ranges")
    found = ranges.groupBy("_in").agg(F.sum("_sum").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group sources first")
    found.sort(key=lambda r: [(x is None, x or "") for x in r["_in"] or []])
    # Python orders strings by code point
    names = sorted({x for r in found for x in r["_in"] or []}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(names)}
    members = [[at[x] for x in r["_in"] or []] for r in found]
    sizes = [sum(r["n"] for r, m in zip(found, members) if i in m) for i in range(len(names))]
    # overlapping sources share tokens: shares are of all distinct tokens
    distinct = sum(r["n"] for r, m in zip(found, members) if m)
    scale = distinct / sum(sizes) if sum(sizes) else 0.0
    targets = capped_shares(sizes, [weights[i % len(weights)] for i in range(len(names))], repeat)
    if scale != 1.0:
        targets = [t * scale for t in targets]
    flow = min_cost_flow([r["n"] for r in found], members, [round(t) for t in targets], repeat)
    plan = spark.createDataFrame(
        [(r["_in"], r["n"], sum(f.values()), [(names[s], sizes[s], targets[s], f[s]) for s in m])
         for r, m, f in zip(found, members, flow)],
        "_in array<string>, _cap long, _want long, "
        "_routed array<struct<source:string,source_size:long,target:double,tokens:long>>")
    plan = plan.withColumn("_full", F.when(F.col("_cap") > 0, F.expr("_want div _cap")).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("_want") - F.col("_full") * F.col("_cap"))
    before = Window.partitionBy("_in").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = (ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
           .join(plan, "_in"))
    upto = F.col("_before") + F.col("_sum")
    here = (F.col("_before") < F.col("_rest")) & (F.col("_rest") < upto)
    # per pattern: the last range taken whole, the range that is cut, and what is before it
    edges = cut.groupBy("_in").agg(
        F.max(F.when((upto <= F.col("_rest")) & (F.col("_rest") > 0), F.col("_range"))).alias("_edge"),
        F.max(F.when(here, F.col("_range"))).alias("_cut"), F.max(F.when(here, F.col("_before"))).alias("_before"))
    # at most MAX_PATTERNS rows
    rows = base.join(F.broadcast(plan.join(edges, "_in", "left")), "_in")
    split = F.coalesce(F.col("_range") == F.col("_cut"), F.lit(False))
    whole = rows.where(~split).withColumn("_more", F.coalesce(F.col("_range") <= F.col("_edge"), F.lit(False)))
    along = Window.partitionBy("_in").orderBy("_hash", "_key", "_size", "_row").rowsBetween(
        Window.unboundedPreceding, -1)
    part = rows.where(split).withColumn(
        "_more", F.col("_before") + F.coalesce(F.sum("_size").over(along), F.lit(0)) + F.col("_size") / 2
        <= F.col("_rest"))
    return whole.unionByName(part).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(mine)],
        F.col("_size").alias(n["size"]), F.col("_in").alias(n["sources"]),
        (F.col("_full") + F.col("_more").cast("long")).alias(n["copies"]),
        ((F.col("_full") + F.col("_more").cast("long")) * F.col("_size")).alias(n["taken"]),
        F.struct(F.col("_want").alias("tokens"), F.col("_routed").alias("by_source")).alias(n["routed"]))
