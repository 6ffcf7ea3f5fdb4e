"""The tracks' inputs, made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.sources.readers import read_table

FXA_SQL = """
fxa AS (
  SELECT o_orderkey AS encounter_id, o_custkey AS patient_nbr,
         CASE o_orderstatus WHEN 'F' THEN '<30' WHEN 'P' THEN '>30' ELSE 'NO' END AS readmitted,
         CAST(1 + o_orderkey % 14 AS INTEGER) AS time_in_hospital,
         lines AS num_lab_procedures, quantity AS num_medications,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS race, c_mktsegment AS age, n_name AS admission_source_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""
FXB_SQL = """
fxb AS (
  SELECT o_orderkey AS appointment_id, o_custkey AS person_id,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS scheduled_ts, CAST(o_orderdate AS DATE) AS scheduled_date,
         CAST((o_orderkey % 200) - 5 AS INTEGER) AS lead_time_days,
         CAST(o_orderdate AS DATE) + CAST((o_orderkey % 200) - 5 AS INTEGER) AS appointment_date,
         CAST((o_orderkey * 7) % 121 - 3 AS DOUBLE) AS age, CASE WHEN c_acctbal < 0 THEN NULL ELSE n_name END AS neighbourhood,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label,
         CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS sms_received, c_mktsegment AS gender,
         CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS scholarship, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS hipertension
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
FXS_SQL = """
fxs AS (
  SELECT event_id, user_id AS person_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS p FROM events
)"""


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, lines = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    totals = lines.groupBy("l_orderkey").agg(F.count("*").alias("num_lab_procedures"), F.sum("l_quantity").alias("num_medications"))
    status = F.when(F.col("o_orderstatus") == "F", "<30").when(F.col("o_orderstatus") == "P", ">30").otherwise("NO")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(totals, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_custkey").alias("patient_nbr"),
        status.alias("readmitted"),
        (1 + F.col("o_orderkey") % 14).cast("int").alias("time_in_hospital"),
        "num_lab_procedures",
        "num_medications",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("race"),
        F.col("c_mktsegment").alias("age"),
        F.col("n_name").alias("admission_source_id"),
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lead = (F.col("o_orderkey") % 200 - 5).cast("int")
    one = lambda c: F.when(c, 1).otherwise(0)
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("appointment_id"),
        F.col("o_custkey").alias("person_id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("scheduled_ts"),
        F.to_date("o_orderdate").alias("scheduled_date"),
        lead.alias("lead_time_days"),
        F.date_add(F.to_date("o_orderdate"), lead).alias("appointment_date"),
        ((key * 7) % 121 - 3).cast("double").alias("age"),
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("n_name")).alias("neighbourhood"),
        one(F.col("o_orderpriority") == "1-URGENT").alias("label"),
        one(key % 3 == 0).alias("sms_received"),
        F.col("c_mktsegment").alias("gender"),
        one(key % 5 == 0).alias("scholarship"),
        one(key % 7 == 0).alias("hipertension"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", F.col("user_id").alias("person_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("p"))
