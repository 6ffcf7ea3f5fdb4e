"""Readmission track: raw text to silver, gold and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrider.functions.scalars import days_after, flag, integer_of_text, unmarked

NUMERIC = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient", "number_emergency", "number_inpatient"]
CATEGORICAL = ["race", "gender", "age", "admission_type_id", "discharge_disposition_id", "admission_source_id", "diabetesMed", "change", "insulin", "A1Cresult"]
FIRST_DAY = "2008-01-01"


def silver(bronze: DataFrame, untouched: tuple[str, ...] = ("ingest_ts",), mark: str = "?") -> DataFrame:
    """Every text column without its mark for missing values."""
    return bronze.select(*[F.col(f"`{c}`") if c in untouched or t != "string" else unmarked(F.col(f"`{c}`"), mark).alias(c) for c, t in bronze.dtypes])


def typed(silver_rows: DataFrame) -> DataFrame:
    return silver_rows.select(
        F.col("encounter_id").cast("bigint").alias("encounter_id"),
        F.col("patient_nbr").cast("bigint").alias("patient_nbr"),
        F.col("time_in_hospital").cast("int").alias("time_in_hospital"),
        "readmitted",
        flag(F.col("readmitted") == "<30").alias("y_readmit_30"),
    )


def gold(typed_rows: DataFrame) -> DataFrame:
    """One row for each encounter, with its day and label."""
    return typed_rows.select("encounter_id", F.col("patient_nbr").alias("person_id"), days_after(FIRST_DAY, F.col("encounter_id") % 365).alias("t0_date"), F.col("y_readmit_30").alias("label"), "time_in_hospital", "readmitted")


def features(silver_rows: DataFrame) -> DataFrame:
    """Ids, label and typed features of encounters that have both ids; numeric and categorical columns that the input lacks are left out."""
    has = set(silver_rows.columns)
    return silver_rows.filter(F.col("encounter_id").isNotNull() & F.col("patient_nbr").isNotNull()).select(
        integer_of_text(F.col("encounter_id").cast("string"), "bigint").alias("encounter_id"),
        integer_of_text(F.col("patient_nbr").cast("string"), "bigint").alias("person_id"),
        flag(F.col("readmitted") == "<30").alias("label"),
        *[integer_of_text(F.col(c).cast("string")).alias(c) for c in NUMERIC if c in has],
        *[F.col(c) for c in CATEGORICAL if c in has],
    )
