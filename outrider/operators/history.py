"""An entity's history, strictly before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_prior_count(df: DataFrame, entity: str, date: str, tie: str, name: str = "prior_appt_count") -> DataFrame:
    """How many of the entity's rows come before this one by date, then by ``tie``; missing dates come last.

    Counts by (entity, date) say how many come before the date; a window orders the rows of one date, so the
    largest one has an entity's rows of a date, not all its rows. Rows without an entity count as one entity's.
    """
    key = df.withColumn("_key", F.struct(F.col(entity).alias("e"), F.col(date).alias("d")))  # structs with NULLs are equal where their parts are
    days = Window.partitionBy("_key.e").orderBy(F.col("_key.d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = key.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("_key").orderBy(F.col(tie).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    own = key.withColumn("_own", F.count("*").over(within))
    return own.join(earlier, "_key").select(*df.columns, (F.col("_own") + F.col("_earlier")).alias(name))
