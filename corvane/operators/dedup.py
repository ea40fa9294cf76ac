"""Deduplication and prefer-left merges with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a given order; the filter on the rank stops work early."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key: that of the largest ordinal, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*keys, "_r.*")


def proximity(rows: DataFrame, keys: list[str], line: str, window: int = 5) -> DataFrame:
    """(keys, kept lines): a line stays if it is more than `window` away from the last one that stayed.

    A fold over each key's distinct sorted lines, since the comparison is with the last kept line.
    """
    lines = F.array_sort(F.collect_set(F.col(line).cast("int")))

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > window), F.array_append(acc, x)).otherwise(acc)

    kept = F.aggregate("_l", F.array().cast("array<int>"), step)
    return rows.groupBy(*keys).agg(lines.alias("_l")).select(*keys, F.explode(kept).alias(line))


def prefer_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All of left, and the rows of right whose keys left lacks."""
    return left.unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti"))
