"""Profiles and quality checks of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_mask(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull()


def _long(df: DataFrame, stats: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate pass over the table, turned into a row for each column."""
    wide = df.agg(*[expr.alias(f"{name}|{c}") for c, each in stats.items() for name, expr in each.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{name}|{c}`").alias(name) for name in each]) for c, each in stats.items()])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing_count, missing_rate); no rows give a rate of 0."""
    n = F.count("*")
    return _long(df, {c: {"missing_count": F.sum(F.col(c).isNull().cast("bigint")), "missing_rate": F.coalesce(F.try_divide(F.sum(F.col(c).isNull().cast("bigint")), n), F.lit(0.0))} for c in columns})


def missing_against_label(df: DataFrame, columns: Sequence[str], label: str, keep_complete: bool = False) -> DataFrame:
    """How often a column is missing, and the label's rate where it is and where it isn't."""
    stats = {}
    for c in columns:
        gone = F.col(c).isNull()
        a, b = F.avg(F.when(gone, F.col(label))), F.avg(F.when(~gone, F.col(label)))
        stats[c] = {"missing_count": F.sum(gone.cast("bigint")), "missing_rate": F.avg(gone.cast("double")), "prev_if_missing": a, "prev_if_observed": b, "diff_missing_minus_observed": a - b}
    out = _long(df, stats)
    return out if keep_complete else out.filter("missing_count > 0")


def has_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df, {c: {"any_missing": F.bool_or(F.col(c).isNull())} for c in columns})


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, and rows beyond one for each key."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), (F.count("*") - F.count_distinct(key)).alias("duplicates"))


def rate_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows and the label's rate of each value; NULL is no value."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def top_groups(df: DataFrame, key: str, label: str, n: int = 15) -> DataFrame:
    """The most frequent values with their rates; equally frequent ones by value."""
    return rate_by(df, key, label).orderBy(F.desc("n"), key).limit(n)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles."""
    from outrider.operators.ordering import quantiles

    q = quantiles(df, column, [0.25, 0.5, 0.75])
    return df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), *[F.lit(v).cast("double").alias(k) for k, v in zip(("q25", "q50", "q75"), q, strict=True)], F.max(column).cast("double").alias("max"))


def quality_bundle(df: DataFrame, key: str, label: str, treatment: str, lead: str, age: str, ages: tuple[float, float] = (0, 110)) -> DataFrame:
    """All checks of a gold table in one pass."""
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return df.agg(
        F.count("*").alias("rows_gold"),
        (F.count("*") - F.count_distinct(key)).alias("dup_key"),
        one(F.col(label).isNull()).alias("label_nulls"),
        one(F.col(treatment).isNull()).alias("treatment_nulls"),
        one(F.col(lead) < 0).alias("lead_negative"),
        one(F.col(age).isNotNull() & ~F.col(age).between(*ages)).alias("age_out_of_range"),
    )


def covariates_by(df: DataFrame, treatment: str, label: str, means: dict[str, str]) -> DataFrame:
    """Rows, the label's rate and means of other columns, by treatment."""
    return df.groupBy(treatment).agg(F.count("*").alias("n"), F.avg(label).alias("rate"), *[F.avg(c).alias(name) for name, c in means.items()])


def entities_with_several(df: DataFrame, entity: str, least: int = 2) -> DataFrame:
    """Entities with at least so many rows."""
    return df.groupBy(entity).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of equally frequent ones."""
    return value_counts(df.filter(F.col(column).isNotNull()), column).groupBy().agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode"))


def scaling(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def modes_of(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """``most_frequent`` of several columns in one pass, as text; None for a column without values."""
    if not columns:
        return {}
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    held = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("x")) for c in columns]
    counts = df.select(F.explode(F.array(*held)).alias("r")).select("r.*").filter("v is not null").groupBy("c", "v", "x").agg(F.count("*").alias("n"))
    found = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("x"), F.col("v"))).alias("mode"))
    return dict.fromkeys(columns) | {r["c"]: r["mode"] for r in found.collect()}  # a row for each column


def scales_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """``scaling`` of several columns in one pass."""
    if not columns:
        return {}
    row = df.agg(*[f for c in columns for f in (F.avg(c), F.stddev_pop(c))]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
