"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the number of rows that share its key; a NULL key keeps its row and has no number.

    The counts have a row for each value; whether they are small enough to send to all executors is left to the planner.
    """
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key, "left")


def with_split(df: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """All columns and the split, for rows that have one."""
    return df.join(splits.select(*keys, "split"), keys)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(key).intersect(b.select(key))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return common_keys(a, b, key).filter(F.col(key).isNotNull()).agg(F.count("*").alias("overlap"))


def stacked(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
