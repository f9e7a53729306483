"""Joins on keys that may hold any share of the rows.

The heavy keys of the large side are measured: at most ``MOST_KEYS`` keys with
over ``ROWS_AT_ONCE`` rows each (a key that is not among the largest holds
less than that share of all rows).  This list is small by its own limit and is
broadcast.  Rows of a heavy key are dealt into as many parts as it has
``ROWS_AT_ONCE`` rows; the other side's row for the key is repeated once for each
part; both sides meet on (key, part).  All other keys have one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 500_000
MOST_KEYS = 1000
PART = "_part"


class HeavyKeys:
    """The heavy keys of ``counts`` (key columns and ``rows``, a row a key)."""

    def __init__(self, counts: DataFrame, key: str, rows: str = "rows"):
        self.key = key
        self.table = (counts.where(F.col(rows) > ROWS_AT_ONCE).orderBy(F.desc(rows), key).limit(MOST_KEYS)
                      .select(F.col(key).alias("_heavy"), F.ceil(F.col(rows) / ROWS_AT_ONCE).cast("bigint").alias("_parts")))

    @staticmethod
    def of(big: DataFrame, key: str) -> "HeavyKeys":
        return HeavyKeys(big.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), key)

    def _parts(self, df: DataFrame) -> DataFrame:
        # at most MOST_KEYS rows
        return (df.join(F.broadcast(self.table), F.col(self.key) == F.col("_heavy"), "left")
                .withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("bigint"))).drop("_heavy"))

    def dealt(self, big: DataFrame, by: Column | str) -> DataFrame:
        """``big`` with the part of each row, told by ``by`` (a row's own id)."""
        return self._parts(big).withColumn(PART, F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")

    def repeated(self, small: DataFrame) -> DataFrame:
        """``small`` with a row for every part of its key."""
        return (self._parts(small).withColumn(PART, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
                .drop("_parts"))


def spread_join(big: DataFrame, small: DataFrame, key: str, by: Column | str, how: str = "inner",
                heavy: HeavyKeys | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has at most one row a key; ``how`` is
    inner, left, left_semi or left_anti."""
    heavy = heavy or HeavyKeys.of(big, key)
    return heavy.dealt(big, by).join(heavy.repeated(small), [key, PART], how).drop(PART)
