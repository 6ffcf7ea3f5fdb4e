"""No-show track: raw text to silver, gold, and the feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrider.contract import require_columns
from outrider.functions.bins import lead_time_bin, small_to_other
from outrider.functions.scalars import clipped, date_of, day_of_week, flag, hour_of, integer_of_double, log1p_of, month_of, normalise_name, number_of, says_yes, timestamp_of, whole_days
from outrider.operators.history import with_prior_count
from outrider.operators.joins import with_frequency

#: Names after normalisation, as the source has them, and as the tables have them.
RENAMED = {"patientid": "person_id", "appointmentid": "appointment_id"}
REQUIRED = ["appointment_id", "person_id", "scheduledday", "appointmentday", "no_show"]
FLAGS = ["scholarship", "hipertension", "diabetes", "alcoholism", "handcap"]
AGES = (0, 110)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns that are there get their new names."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def silver(bronze: DataFrame) -> DataFrame:
    """Normalised names, numbers and times where they parse, dates, lead time, and the label; ages out of range go, unknown ones stay."""
    plain = renamed(renamed(bronze, {c: normalise_name(c) for c in bronze.columns}), RENAMED)
    require_columns(plain, REQUIRED)
    numbers = [c for c in ["age", "sms_received", *FLAGS] if c in plain.columns]
    out = plain.withColumns({c: number_of(F.col(c)) for c in ["appointment_id", "person_id", *numbers]} | {"scheduled_ts": timestamp_of(F.col("scheduledday")), "appointment_ts": timestamp_of(F.col("appointmentday"))})
    out = out.withColumns({"scheduled_date": F.to_date("scheduled_ts"), "appointment_date": F.to_date("appointment_ts")})
    out = out.withColumn("lead_time_days", whole_days(F.col("appointment_date"), F.col("scheduled_date")))
    out = out.withColumns({"date_inversion_flag": flag(F.col("lead_time_days") < 0), "label": says_yes(F.col("no_show"))})
    return out.filter(F.col("age").isNull() | F.col("age").between(*AGES)) if "age" in numbers else out


def without_inversions(rows: DataFrame) -> DataFrame:
    """Appointments that aren't before they were made; unknown lead times stay."""
    return rows.filter(F.col("lead_time_days").isNull() | (F.col("lead_time_days") >= 0))


def gold(silver_rows: DataFrame) -> DataFrame:
    """The modelling table: typed columns of appointments that have an id."""
    has = set(silver_rows.columns)
    ids = [integer_of_double(F.col(c), "bigint").alias(c) if dict(silver_rows.dtypes)[c] == "double" else F.col(c).cast("bigint").alias(c) for c in ("appointment_id", "person_id")]
    whole = lambda c: integer_of_double(F.col(c).cast("double")).alias(c)
    return silver_rows.filter(F.col("appointment_id").isNotNull()).select(
        *ids,
        *[F.col(c) for c in ("scheduled_ts", "appointment_ts", "scheduled_date", "appointment_date") if c in has],
        F.col("lead_time_days").cast("int").alias("lead_time_days"),
        flag(F.col("lead_time_days") < 0).alias("date_inversion_flag"),
        F.col("age").cast("double").alias("age"),
        *[F.col(c).cast("string").alias(c) for c in ("gender", "neighbourhood") if c in has],
        *[whole(c) for c in [*FLAGS, "sms_received"] if c in has],
        F.col("label").cast("int").alias("label"),
    )


def features(gold_rows: DataFrame, small: int = 200, null_lead: str = "as_longest", as_of: str = "appt_date") -> DataFrame:
    """One row for each appointment: calendar, lead time, the neighbourhood's size, and the person's earlier appointments.

    A NULL lead time counts as the longest, and as 0 in the logarithm; with ``null_lead="propagate"`` it stays NULL.
    Earlier appointments are those before by ``as_of``: ``appt_date``, or ``sched_date`` for what was known when this one was made.
    """
    has = set(gold_rows.columns)
    stamp = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    base = gold_rows.select(
        *[c for c in gold_rows.columns if c not in ("scheduled_ts", "appointment_ts", "scheduled_date", "appointment_date", "date_inversion_flag")],
        date_of(stamp("appointment_date"), stamp("appointment_ts")).alias("appt_date"),
        date_of(stamp("scheduled_date"), stamp("scheduled_ts")).alias("sched_date"),
        hour_of(timestamp_of(stamp("scheduled_ts"))).alias("sched_hour"),
    )
    lead = F.col("lead_time_days")
    known = (lambda c: F.when(lead.isNotNull(), c)) if null_lead == "propagate" else (lambda c: c)
    timed = base.withColumns({
        "appt_dow": day_of_week(F.col("appt_date")),
        "appt_month": month_of(F.col("appt_date")),
        "sched_dow": day_of_week(F.col("sched_date")),
        "sched_month": month_of(F.col("sched_date")),
        "lead_time_clipped": known(clipped(lead, -1, 180)),
        "lead_time_log1p": known(log1p_of(lead)),
        "lead_time_bin": known(lead_time_bin(lead)),
    })
    sized = with_frequency(timed, "neighbourhood", "nbhd_n")
    counted = with_prior_count(sized, "person_id", as_of, "appointment_id")
    own = ["appointment_id", "person_id", "label", "sms_received", "age", "gender"]
    return counted.select(
        *[c for c in own if c in has],
        small_to_other(F.col("neighbourhood"), F.col("nbhd_n"), small).alias("neighbourhood"),
        *[c for c in FLAGS if c in has],
        "lead_time_days", "lead_time_clipped", "lead_time_log1p", "lead_time_bin", "appt_date", "sched_date", "appt_dow", "appt_month", "sched_dow", "sched_month", "sched_hour", "nbhd_n", "prior_appt_count",
    )
