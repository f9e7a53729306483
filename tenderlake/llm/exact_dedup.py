"""Exact deduplication by progressive refinement (native).

Texts are equal when they are identical without white space.  Documents are
grouped by normalised length, then, where a length occurs twice, by a hash of
the first characters, and only rows of groups that still hold two rows meet
the full SHA-256 of their content.  Each refinement is one aggregate with
partial aggregation, so a group with a third of all rows costs one row per
task; joins back are equi-joins that Spark splits when skewed.

Defined cases: a null text is the empty text; empty texts (white space only)
are copies of each other; a null id sorts after all others; of fully equal
rows one stays; an empty table gives an empty result; further columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import fresh, saved, text_or_empty, without_spaces

PREFIX_CHARS = 256
OUT = ("keep_id", "group_size", "kept")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``id_col``, ``carry`` (expressions over the
    input row, evaluated while its content is at hand), ``keep_id``,
    ``group_size`` and ``kept``.

    Of a class the row with the most code points, then the smallest id,
    stays."""
    carry = carry or {}
    norm = without_spaces(text_or_empty(text_col))
    keys = [F.length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_pre")]

    # 1. by length, 2. by prefix hash among the lengths that occur twice
    # (rows of a hot length are counted before they meet)
    light = saved(docs.select(*keys).groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("n")), "dedup-light")
    lengths = light.groupBy("_len").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("_len")
    prefixes = (light.join(lengths, "_len", "left_semi").where("n > 1")
                .select("_len", "_pre", F.lit(True).alias("_open")))

    # 3. the full hash, for rows of surviving groups only
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *keys,
                       *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    rows = saved(
        rows.join(prefixes, ["_len", "_pre"], "left")
        .select("_id", "_len", "_pre", F.length("_text").alias("_chars"),
                F.when(F.col("_open"), F.sha2(without_spaces(F.col("_text")), 256)).alias("_full"),
                F.monotonically_increasing_id().alias("_row"), *[f"_c{i}" for i in range(len(carry))]),
        "dedup-rows")
    key = ["_len", "_pre", "_full"]
    order = F.struct((-F.col("_chars")).alias("a"), F.col("_id").isNull().alias("b"),
                     F.col("_id").alias("id"), F.col("_row").alias("row"))
    same = (rows.where(F.col("_full").isNotNull()).groupBy(*key)
            .agg(F.min(order).alias("_keep"), F.count(F.lit(1)).alias("_size"))
            .where("_size > 1"))
    found = rows.join(same, key, "left")
    first = F.col("_keep.row")
    return found.select(
        F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)],
        F.when(first.isNull(), F.col("_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (first.isNull() | (first == F.col("_row"))).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    n = fresh(docs, "whole")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    got = classes(docs, id_col, text_col, {n["whole"]: whole})
    return got.where("kept").select(*[F.col(n["whole"]).getField(c).alias(c) for c in docs.columns])
