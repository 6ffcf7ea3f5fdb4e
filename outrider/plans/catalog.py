"""The query catalogue: for each operator a query on the test tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.functions import bins, scalars
from outrider.operators import bootstrap, history, joins, metrics, ordering, profile, splits
from outrider.plans import appointments as no_show
from outrider.plans import encounters as readmission
from outrider.plans.fixtures import FXA_SQL, FXB_SQL, FXS_SQL, appointments, encounters, scored_events
from outrider.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from outrider.session import shared_folder
from outrider.sources.readers import inline, read_table, registered

SMALL_GROUP = 600
COVARIATES = {"mean_age": "age", "mean_lead": "lead_time_days", "scholarship_rate": "scholarship", "hipertension_rate": "hipertension"}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as sums depend on their order; dates as text, as engines hand them over differently."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def code_text(c: Column) -> Column:
    """Ids as text: some with a half, some with a letter, some with the mark for missing."""
    return F.when(c % 11 == 0, "?").when(c % 7 == 0, F.concat(F.lit("x"), c.cast("string"))).when(c % 2 == 0, F.concat(c.cast("string"), F.lit(".5"))).otherwise(c.cast("string"))


CODE_SQL = "CASE WHEN o_orderkey % 11 = 0 THEN '?' WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 2 = 0 THEN o_orderkey || '.5' ELSE CAST(o_orderkey AS VARCHAR) END"
HASH_SQL = "('0x' || substr(md5({seed}CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def hash_sql(key: str, seed: str = "") -> str:
    return HASH_SQL.format(key=key, seed=f"'{seed}' || " if seed else "")


def split_sql(key: str) -> str:
    u = f"({hash_sql(key)} % 1000000) / 1000000.0::DOUBLE"
    return f"CASE WHEN {u} < 0.70::DOUBLE THEN 'train' WHEN {u} < 0.85::DOUBLE THEN 'valid' ELSE 'test' END"


# --- sources -------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def SRC_04_full_scan(spark, d):
    return read_table(spark, d, "nation")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def SRC_05_column_scan(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@query(f"WITH {FXB_SQL} SELECT appointment_id, person_id, label, sms_received, {split_sql('person_id')} AS split, age, lead_time_days FROM fxb")
def SRC_06_contract_scan(spark, d):
    from outrider.contract import Contract

    contract = Contract(["appointment_id", "person_id"], ["age", "lead_time_days"], ["age", "lead_time_days"], [], "label", "sms_received")
    return contract.select(splits.hash_split(appointments(spark, d), "person_id"), "split")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def SRC_07_view_scan(spark, d):
    registered(read_table(spark, d, "nation").filter("n_regionkey = 1"), "outrider_region_one")
    return spark.sql("SELECT n_name, n_regionkey FROM outrider_region_one")


@query("SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (2, NULL, 1.5::DOUBLE), (3, 'c', NULL)) t(k, name, v)")
def SRC_13_inline_rows(spark, d):
    return inline(spark, [(1, "a", 0.5), (2, None, 1.5), (3, "c", None)], "k int, name string, v double")


# --- projections ---------------------------------------------------------------------------------


@query("SELECT *, o_totalprice * 2 AS twice FROM orders")
def PRJ_01_star_and_expression(spark, d):
    return read_table(spark, d, "orders").select("*", (F.col("o_totalprice") * 2).alias("twice"))


@query(f"SELECT o_orderkey, nullif({CODE_SQL}, '?') AS code, nullif(o_orderpriority, '?') AS o_orderpriority FROM orders")
def PRJ_02_marks_to_null(spark, d):
    return readmission.silver(read_table(spark, d, "orders").select("o_orderkey", code_text(F.col("o_orderkey")).alias("code"), "o_orderpriority"))


@query("SELECT o_orderkey AS encounter_id, o_custkey AS person_id FROM orders")
def PRJ_04_rename(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("person_id"))


@query("SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def PRJ_05_rename_present(spark, d):
    return no_show.renamed(read_table(spark, d, "nation"), {"n_nationkey": "nation_id", "n_name": "nation", "absent": "nothing"})


@query(f"WITH {FXA_SQL} SELECT encounter_id, patient_nbr, time_in_hospital, readmitted, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS y_readmit_30 FROM fxa")
def PRJ_07_strict_cast(spark, d):
    text = encounters(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("encounter_id", "patient_nbr", "time_in_hospital", "readmitted")])
    return readmission.typed(text)


@query(f"SELECT o_orderkey, TRY_CAST({CODE_SQL} AS INTEGER) AS whole, TRY_CAST({CODE_SQL} AS BIGINT) AS large FROM orders")
def PRJ_08_safe_cast(spark, d):
    code = code_text(F.col("o_orderkey"))
    return read_table(spark, d, "orders").select("o_orderkey", scalars.integer_of_text(code).alias("whole"), scalars.integer_of_text(code, "bigint").alias("large"))


@query(f"SELECT o_orderkey, TRY_CAST({CODE_SQL} AS DOUBLE) AS number FROM orders")
def PRJ_09_coerce_number(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", scalars.number_of(code_text(F.col("o_orderkey"))).alias("number"))


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts FROM orders")
def PRJ_10_coerce_timestamp(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return read_table(spark, d, "orders").select("o_orderkey", text.try_cast("timestamp_ntz").alias("ts"))


@query("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
def PRJ_11_drop_columns(spark, d):
    return read_table(spark, d, "customer").drop("c_acctbal", "c_name")


@query("SELECT c_mktsegment, c_custkey FROM customer")
def PRJ_12_keep_by_list(spark, d):
    table = read_table(spark, d, "customer")
    return table.select(*[c for c in ("c_mktsegment", "absent", "c_custkey") if c in table.columns])


@query("SELECT o.*, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def PRJ_14_star_and_joined_column(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(o["*"], c["c_mktsegment"])


FEATURES_SQL = f"""
WITH {FXB_SQL},
time_feats AS (
  SELECT *, appointment_date AS appt_date, scheduled_date AS sched_date, CAST(extract('hour' FROM scheduled_ts) AS BIGINT) AS sched_hour,
         CAST(extract('dow' FROM appointment_date) AS BIGINT) AS appt_dow, CAST(extract('month' FROM appointment_date) AS BIGINT) AS appt_month,
         CAST(extract('dow' FROM scheduled_date) AS BIGINT) AS sched_dow, CAST(extract('month' FROM scheduled_date) AS BIGINT) AS sched_month FROM fxb
), lead_feats AS (
  SELECT *, CAST(greatest(-1, least(lead_time_days, 180)) AS INTEGER) AS lead_time_clipped, round(ln(1 + greatest(0, lead_time_days)), 6) AS lead_time_log1p,
         CASE WHEN lead_time_days <= 0 THEN 'same_day' WHEN lead_time_days <= 2 THEN '1_2' WHEN lead_time_days <= 7 THEN '3_7' WHEN lead_time_days <= 14 THEN '8_14'
              WHEN lead_time_days <= 30 THEN '15_30' WHEN lead_time_days <= 60 THEN '31_60' ELSE '61_plus' END AS lead_time_bin FROM time_feats
), nbhd_counts AS (SELECT neighbourhood, count(*) AS nbhd_n FROM lead_feats GROUP BY 1),
hist AS (
  SELECT l.*, nbhd_n, CASE WHEN nbhd_n < {SMALL_GROUP} THEN 'OTHER_SMALL' ELSE l.neighbourhood END AS grp,
         count(*) OVER (PARTITION BY person_id ORDER BY appt_date, appointment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_appt_count
  FROM lead_feats l LEFT JOIN nbhd_counts c ON l.neighbourhood = c.neighbourhood
)
SELECT appointment_id, person_id, label, sms_received, age, gender, grp AS neighbourhood, scholarship, hipertension, lead_time_days, lead_time_clipped, lead_time_log1p,
       lead_time_bin, CAST(appt_date AS VARCHAR) AS appt_date, CAST(sched_date AS VARCHAR) AS sched_date, appt_dow, appt_month, sched_dow, sched_month, sched_hour, nbhd_n, prior_appt_count FROM hist
"""


@query(FEATURES_SQL)
def PRJ_15_appointment_features(spark, d):
    return rounded(no_show.features(appointments(spark, d), SMALL_GROUP))


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n >= 12")
def PRJ_16_derived_table(spark, d):
    return profile.entities_with_several(read_table(spark, d, "orders"), "o_custkey", 12)


@query(f"WITH {FXS_SQL} SELECT event_id, label, p, round(1 / (1 + exp(-(2 * p - 1))), 6) AS p_hat FROM fxs")
def PRJ_17_prediction_column(spark, d):
    return rounded(scored_events(spark, d).select("event_id", "label", "p", scalars.sigmoid(2 * F.col("p") - 1).alias("p_hat")))


# --- filters -------------------------------------------------------------------------------------


@query(f"WITH {FXA_SQL} SELECT encounter_id, race FROM fxa WHERE race IS NOT NULL AND num_lab_procedures IS NOT NULL")
def FLT_01_not_null(spark, d):
    return encounters(spark, d).filter(F.col("race").isNotNull() & F.col("num_lab_procedures").isNotNull()).select("encounter_id", "race")


AGE_SQL = "nullif(age, 50)"


@query(f"WITH {FXB_SQL} SELECT appointment_id, {AGE_SQL} AS age FROM fxb WHERE {AGE_SQL} IS NULL OR {AGE_SQL} BETWEEN 0 AND 110")
def FLT_02_range_or_null(spark, d):
    age = F.nullif(F.col("age"), F.lit(50.0))
    return appointments(spark, d).select("appointment_id", age.alias("age")).filter(F.col("age").isNull() | F.col("age").between(0, 110))


@query(f"WITH {FXB_SQL} SELECT appointment_id, age FROM (SELECT appointment_id, {AGE_SQL} AS age FROM fxb) t WHERE age IS NOT NULL AND NOT age BETWEEN 0 AND 110")
def FLT_03_out_of_range(spark, d):
    age = F.nullif(F.col("age"), F.lit(50.0))
    return appointments(spark, d).select("appointment_id", age.alias("age")).filter(F.col("age").isNotNull() & ~F.col("age").between(0, 110))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def FLT_04_equality(spark, d):
    return read_table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")


@query(f"WITH {FXA_SQL} SELECT round(avg(CASE WHEN race IS NULL THEN y END), 6) AS masked, round(avg(CASE WHEN race IS NOT NULL THEN y END), 6) AS complement FROM (SELECT race, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS y FROM fxa) t")
def FLT_05_mask_and_complement(spark, d):
    rows = readmission.features(encounters(spark, d))
    gone = F.col("race").isNull()
    return rounded(rows.agg(F.avg(F.when(gone, F.col("label"))).alias("masked"), F.avg(F.when(~gone, F.col("label"))).alias("complement")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 14")
def FLT_06_having(spark, d):
    registered(read_table(spark, d, "orders"), "outrider_orders")
    return spark.sql("SELECT o_custkey, count(*) AS n FROM outrider_orders GROUP BY o_custkey HAVING n > 14")


@query("SELECT count(*) AS straddling FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) t WHERE k > 1")
def FLT_07_filter_over_aggregate(spark, d):
    return splits.straddling(read_table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("split")), "o_custkey")


@query(f"WITH {FXS_SQL} SELECT event_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS flagged FROM fxs")
def FLT_08_score_threshold(spark, d):
    return scored_events(spark, d).select("event_id", scalars.flag(F.col("p") >= 0.5).alias("flagged"))


@query(f'WITH {FXA_SQL} SELECT \'race\' AS "column", count(*) FILTER (race IS NULL) AS missing_count, round(avg((race IS NULL)::INT), 6) AS missing_rate FROM fxa HAVING missing_rate > 0.1')
def FLT_09_missing_rate(spark, d):
    return rounded(profile.missingness(encounters(spark, d), ["race", "num_medications", "age"]).filter("missing_rate > 0.1"))


@query("SELECT max(CASE WHEN n_nationkey = 7 THEN n_name END) AS found FROM nation")
def FLT_14_lookup_by_key(spark, d):
    return read_table(spark, d, "nation").agg(F.max(F.when(F.col("n_nationkey") == 7, F.col("n_name"))).alias("found"))


# --- joins and sets ------------------------------------------------------------------------------


@query(f"WITH {FXB_SQL} SELECT appointment_id, f.neighbourhood, nbhd_n FROM fxb f LEFT JOIN (SELECT neighbourhood, count(*) AS nbhd_n FROM fxb GROUP BY 1) c ON f.neighbourhood = c.neighbourhood")
def J_01_left_join_aggregate(spark, d):
    return joins.with_frequency(appointments(spark, d), "neighbourhood", "nbhd_n").select("appointment_id", "neighbourhood", "nbhd_n")


@query(f"WITH {FXB_SQL} SELECT appointment_id, person_id, label, {split_sql('person_id')} AS split FROM fxb")
def J_02_inner_join_two_keys(spark, d):
    rows = appointments(spark, d).select("appointment_id", "person_id", "label")
    return joins.with_split(rows, splits.hash_split(rows, "person_id"), ["appointment_id", "person_id"])


@query("SELECT count(*) AS overlap FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') t WHERE o_custkey IS NOT NULL")
def J_03_key_overlap(spark, d):
    o = read_table(spark, d, "orders")
    return joins.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


def picks_sql(draws: int) -> str:
    return f"""
g AS (SELECT person_id, row_number() OVER (ORDER BY person_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT person_id FROM fxs WHERE person_id IS NOT NULL) t),
ids AS (SELECT unnest(range(0, {draws} * (SELECT max(n) FROM g))) AS id),
picks AS (SELECT CAST(floor(id / (SELECT max(n) FROM g)) AS BIGINT) AS draw, CAST(floor(({hash_sql('id', '42:')} % 1000000) / 1000000.0::DOUBLE * (SELECT max(n) FROM g)) AS BIGINT) + 1 AS r FROM ids),
w AS (SELECT draw, person_id, count(*) AS weight FROM picks JOIN g USING (r) GROUP BY ALL)"""


DRAWS = 500


@query(f"WITH {FXS_SQL}, {picks_sql(DRAWS)} SELECT draw, sum(weight)::BIGINT AS rows_drawn, sum(weight * label)::BIGINT AS positives FROM fxs JOIN w USING (person_id) GROUP BY draw")
def J_04_bootstrap_expansion(spark, d):
    rows = scored_events(spark, d)
    sums = {"rows_drawn": F.count("*"), "positives": F.sum("label")}
    return bootstrap.drawn_sums(rows, "person_id", sums, bootstrap.picked(rows, "person_id", DRAWS))


@query(f'WITH {FXA_SQL} SELECT \'race\' AS "column", count(*) FILTER (race IS NULL) AS missing_count, round(avg((race IS NULL)::INT), 6) AS missing_rate FROM fxa UNION ALL SELECT \'num_medications\', count(*) FILTER (num_medications IS NULL), round(avg((num_medications IS NULL)::INT), 6) FROM fxa')
def J_05_two_statistics_by_column(spark, d):
    return rounded(profile.missingness(encounters(spark, d), ["race", "num_medications"]))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def U_01_key_intersection(spark, d):
    o = read_table(spark, d, "orders")
    return joins.common_keys(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def U_02_row_accumulation(spark, d):
    o = read_table(spark, d, "orders")
    return joins.stacked(*[profile.value_counts(o, c).select(F.lit(kind).alias("kind"), F.col(c).alias("value"), "n") for kind, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])


@query(f"WITH {FXS_SQL}, {picks_sql(DRAWS)} SELECT draw, person_id, weight FROM w")
def U_03_bag_with_multiplicity(spark, d):
    return splits.bootstrap_weights(scored_events(spark, d), "person_id", DRAWS)


@query("SELECT DISTINCT user_id FROM events")
def U_04_unique_keys(spark, d):
    return read_table(spark, d, "events").select("user_id").distinct()


# --- aggregates ----------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def A_01_count(spark, d):
    return read_table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def A_02_count_distinct(spark, d):
    return read_table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def A_03_duplicates(spark, d):
    return profile.duplicates(read_table(spark, d, "lineitem"), "l_orderkey")


@query(f"WITH {FXB_SQL} SELECT round(avg(label), 6) AS prevalence FROM fxb")
def A_04_prevalence(spark, d):
    return rounded(appointments(spark, d).agg(F.avg("label").alias("prevalence")))


@query(f"WITH {FXA_SQL} SELECT sum(CASE WHEN race IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_race, sum(CASE WHEN time_in_hospital < 1 OR time_in_hospital > 14 THEN 1 ELSE 0 END)::BIGINT AS bad_stay FROM fxa")
def A_05_conditional_sum(spark, d):
    return encounters(spark, d).agg(F.sum(scalars.flag(F.col("race").isNull())).alias("null_race"), F.sum(scalars.flag(~F.col("time_in_hospital").between(1, 14))).alias("bad_stay"))


@query(f"WITH {FXB_SQL} SELECT sum(CASE WHEN lead_time_days < 0 THEN 1 ELSE 0 END)::BIGINT AS inversions FROM fxb")
def A_06_flag_sum(spark, d):
    return no_show.gold(appointments(spark, d)).agg(F.sum("date_inversion_flag").alias("inversions"))


@query(f"WITH {FXB_SQL} SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM (SELECT count(*) OVER (PARTITION BY person_id ORDER BY appointment_date, appointment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM fxb) t")
def A_07_min_max_avg(spark, d):
    rows = history.with_prior_count(appointments(spark, d), "person_id", "appointment_date", "appointment_id", "n")
    return rounded(rows.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean")))


@query(f"WITH {FXB_SQL} SELECT neighbourhood, count(*) AS n FROM fxb GROUP BY 1")
def A_08_group_count(spark, d):
    return profile.value_counts(appointments(spark, d), "neighbourhood")


@query(f"WITH {FXB_SQL} SELECT {split_sql('person_id')} AS split, count(*) AS rows, count(DISTINCT person_id) AS people, round(avg(label), 6) AS prevalence FROM fxb GROUP BY 1")
def A_09_group_multi_aggregate(spark, d):
    return rounded(splits.split_quality(splits.hash_split(appointments(spark, d), "person_id"), "person_id", "label"))


@query(f"WITH {FXB_SQL} SELECT sms_received, count(*) AS n, round(avg(label), 6) AS rate, round(avg(age), 6) AS mean_age, round(avg(lead_time_days), 6) AS mean_lead, round(avg(scholarship), 6) AS scholarship_rate, round(avg(hipertension), 6) AS hipertension_rate FROM fxb GROUP BY 1")
def A_10_covariates_by_treatment(spark, d):
    return rounded(profile.covariates_by(appointments(spark, d), "sms_received", "label", COVARIATES))


MISSING_COLUMNS = ["race", "num_lab_procedures", "num_medications", "age"]


@query(f"WITH {FXA_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, round(avg(({c} IS NULL)::INT), 6) AS missing_rate FROM fxa" for c in MISSING_COLUMNS))
def A_11_missingness(spark, d):
    return rounded(profile.missingness(encounters(spark, d), MISSING_COLUMNS))


def missing_label_sql(c: str) -> str:
    y = "CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END"
    a, b = f"avg(CASE WHEN {c} IS NULL THEN {y} END)", f"avg(CASE WHEN {c} IS NOT NULL THEN {y} END)"
    return f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, round(avg(({c} IS NULL)::INT), 6) AS missing_rate, round({a}, 6) AS prev_if_missing, round({b}, 6) AS prev_if_observed, round({a} - {b}, 6) AS diff_missing_minus_observed FROM fxa"


@query(f"WITH {FXA_SQL} SELECT * FROM (" + " UNION ALL ".join(map(missing_label_sql, MISSING_COLUMNS)) + ") t WHERE missing_count > 0")
def A_12_missing_against_label(spark, d):
    rows = encounters(spark, d).withColumn("label", scalars.flag(F.col("readmitted") == "<30"))
    return rounded(profile.missing_against_label(rows, MISSING_COLUMNS, "label"))


@query(f"WITH {FXB_SQL} SELECT neighbourhood, count(*) AS n, round(avg(label), 6) AS rate FROM fxb WHERE neighbourhood IS NOT NULL GROUP BY 1")
def A_13_rate_by_key(spark, d):
    return rounded(profile.rate_by(appointments(spark, d), "neighbourhood", "label"))


LEAD_SQL = "CASE WHEN lead_time_days < -0.1 OR lead_time_days > 180 THEN NULL WHEN lead_time_days <= 0 THEN '(-0.101, 0]' WHEN lead_time_days <= 2 THEN '(0, 2]' WHEN lead_time_days <= 7 THEN '(2, 7]' WHEN lead_time_days <= 14 THEN '(7, 14]' WHEN lead_time_days <= 30 THEN '(14, 30]' WHEN lead_time_days <= 60 THEN '(30, 60]' ELSE '(60, 180]' END"


@query(f"WITH {FXB_SQL} SELECT lead_bucket, count(*) AS n, round(avg(label), 6) AS rate FROM (SELECT {LEAD_SQL} AS lead_bucket, label FROM fxb) t WHERE lead_bucket IS NOT NULL GROUP BY 1")
def A_14_rate_by_bucket(spark, d):
    rows = appointments(spark, d).withColumn("lead_bucket", bins.cut_label(F.col("lead_time_days"), bins.LEAD_EDGES))
    return rounded(profile.rate_by(rows, "lead_bucket", "label"))


@query(f"WITH {FXB_SQL} SELECT neighbourhood, count(*) AS n, round(avg(label), 6) AS rate FROM fxb WHERE neighbourhood IS NOT NULL GROUP BY 1 ORDER BY n DESC, neighbourhood LIMIT 15")
def A_15_top_groups(spark, d):
    return rounded(profile.top_groups(appointments(spark, d), "neighbourhood", "label"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def A_16_value_counts(spark, d):
    return profile.value_counts(read_table(spark, d, "orders"), "o_orderpriority")


@query("SELECT count(*) AS entities FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t WHERE n > 1")
def A_17_two_level(spark, d):
    return profile.entities_with_several(read_table(spark, d, "orders"), "o_custkey").agg(F.count("*").alias("entities"))


@query(f"WITH {FXS_SQL} SELECT label, round(median(p), 6) AS median_p FROM fxs GROUP BY 1")
def A_18_median(spark, d):
    return rounded(scored_events(spark, d).groupBy("label").agg(F.median("p").alias("median_p")))


QUANTILE_SHARES = [0.0, 0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]


@query("SELECT unnest([" + ", ".join(f"{s}::DOUBLE" for s in QUANTILE_SHARES) + f"]) AS share, round(unnest(quantile_cont(o_totalprice, {QUANTILE_SHARES})), 6) AS value FROM orders")
def A_19_quantiles(spark, d):
    values = ordering.quantiles(read_table(spark, d, "orders"), "o_totalprice", QUANTILE_SHARES)
    return rounded(inline(spark, list(zip(QUANTILE_SHARES, values, strict=True)), "share double, value double"))


DRAW_SQL = f"WITH {FXS_SQL}, {picks_sql(DRAWS)}, m AS (SELECT draw, sum(weight * label) / sum(weight)::DOUBLE AS prevalence, sum(weight * (p - label) * (p - label)) / sum(weight)::DOUBLE AS brier FROM fxs JOIN w USING (person_id) GROUP BY draw)"


@query(DRAW_SQL + " SELECT round(quantile_cont(brier, 0.025), 6) AS low, round(quantile_cont(brier, 0.975), 6) AS high FROM m")
def A_20_percentile_interval(spark, d):
    rows = scored_events(spark, d)
    draws = splits.bootstrap_pointwise(rows, "person_id", draws=DRAWS)
    return rounded(draws.agg(F.percentile("brier", F.lit(0.025)).alias("low"), F.percentile("brier", F.lit(0.975)).alias("high")))


@query("SELECT count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS max FROM customer")
def A_21_describe(spark, d):
    return rounded(profile.describe(read_table(spark, d, "customer"), "c_acctbal"))


@query(f"WITH {FXA_SQL} SELECT 'race' AS \"column\", bool_or(race IS NULL) AS any_missing FROM fxa UNION ALL SELECT 'age', bool_or(age IS NULL) FROM fxa")
def A_22_any_missing(spark, d):
    return profile.has_missing(encounters(spark, d), ["race", "age"])


@query("SELECT min_by(o_orderpriority, (n, o_orderpriority)) AS rarest, max_by(o_orderpriority, (n, o_orderpriority)) AS commonest FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) t")
def A_23_arg_min_max(spark, d):
    counts = profile.value_counts(read_table(spark, d, "orders"), "o_orderpriority")
    key = F.struct("n", "o_orderpriority")
    return counts.agg(F.min_by("o_orderpriority", key).alias("rarest"), F.max_by("o_orderpriority", key).alias("commonest"))


@query(f"WITH {FXB_SQL} SELECT count(*) AS rows_gold, count(*) - count(DISTINCT appointment_id) AS dup_key, sum((label IS NULL)::INT)::BIGINT AS label_nulls, sum((sms_received IS NULL)::INT)::BIGINT AS treatment_nulls, sum((lead_time_days < 0)::INT)::BIGINT AS lead_negative, sum((age IS NOT NULL AND NOT age BETWEEN 0 AND 110)::INT)::BIGINT AS age_out_of_range FROM fxb")
def A_24_quality_bundle(spark, d):
    return profile.quality_bundle(appointments(spark, d), "appointment_id", "label", "sms_received", "lead_time_days", "age")


@query(f"WITH {FXA_SQL} SELECT race AS mode FROM fxa WHERE race IS NOT NULL GROUP BY race ORDER BY count(*) DESC, race LIMIT 1")
def A_25_mode(spark, d):
    return profile.most_frequent(encounters(spark, d), "race")


@query(f"WITH {FXA_SQL} SELECT round(avg(num_medications), 6) AS mean, round(stddev_pop(num_medications), 6) AS std FROM fxa")
def A_26_scaling(spark, d):
    return rounded(profile.scaling(encounters(spark, d), "num_medications"))


# --- windows, bins, order ------------------------------------------------------------------------

PRIOR_SQL = f"WITH {FXB_SQL} SELECT appointment_id, count(*) OVER (PARTITION BY person_id ORDER BY {{date}}, appointment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_appt_count FROM fxb"


@query(PRIOR_SQL.format(date="appointment_date"))
def W_01_prior_count(spark, d):
    return history.with_prior_count(appointments(spark, d), "person_id", "appointment_date", "appointment_id").select("appointment_id", "prior_appt_count")


@query(f"WITH {FXS_SQL} SELECT event_id, row_number() OVER w AS rank, sum(label) OVER w::BIGINT AS running FROM fxs WINDOW w AS (ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def W_02_running_sum(spark, d):
    rows = scored_events(spark, d)
    return metrics.running_sum(ordering.global_rank(rows, "p", "event_id"), "rank", "label", rows.count()).select("event_id", "rank", "running")


GAINS_SQL = f"WITH {FXS_SQL} SELECT event_id, row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER ()::DOUBLE, 6) AS population, round(sum(label) OVER w / sum(label) OVER ()::DOUBLE, 6) AS gain FROM fxs WINDOW w AS (ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(GAINS_SQL.replace("row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER ()::DOUBLE, 6) AS population, ", ""))
def W_03_cumulative_share(spark, d):
    return rounded(metrics.cumulative_gains(scored_events(spark, d), "event_id").select("event_id", "gain"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def W_04_global_rank(spark, d):
    return ordering.global_rank(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


CUM_SQL = f"{FXS_SQL}, per AS (SELECT p AS score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM fxs GROUP BY p), cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS all_pos, sum(n) OVER () AS all_n FROM per WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(f"WITH {CUM_SQL} SELECT * FROM cum")
def W_05_cumulative_by_threshold(spark, d):
    return ordering.cumulative_by_score(scored_events(spark, d), "label", "p")


@query(f"WITH {FXB_SQL} SELECT appointment_id, CASE WHEN lead_time_days <= 0 THEN 'same_day' WHEN lead_time_days <= 2 THEN '1_2' WHEN lead_time_days <= 7 THEN '3_7' WHEN lead_time_days <= 14 THEN '8_14' WHEN lead_time_days <= 30 THEN '15_30' WHEN lead_time_days <= 60 THEN '31_60' ELSE '61_plus' END AS lead_time_bin FROM (SELECT appointment_id, nullif(lead_time_days, 9) AS lead_time_days FROM fxb) t")
def B_01_case_bins(spark, d):
    return appointments(spark, d).select("appointment_id", bins.lead_time_bin(F.nullif("lead_time_days", F.lit(9))).alias("lead_time_bin"))


@query(f"WITH {FXB_SQL} SELECT appointment_id, {LEAD_SQL} AS lead_bucket FROM fxb")
def B_02_fixed_edges(spark, d):
    return appointments(spark, d).select("appointment_id", bins.cut_label(F.col("lead_time_days"), bins.LEAD_EDGES).alias("lead_bucket"))


DECILE_SQL = f"{FXS_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM fxs), dec AS (SELECT event_id, label, p, greatest(1, len(list_filter(edges, lambda x: x < p)))::INTEGER AS risk_decile FROM fxs, e)"


@query(f"WITH {DECILE_SQL} SELECT event_id, risk_decile FROM dec")
def B_03_quantile_bins(spark, d):
    return metrics.with_risk_decile(scored_events(spark, d)).select("event_id", "risk_decile")


EQUAL_SQL = "CAST(" + " + ".join(f"(p >= {k * 0.1!r}::DOUBLE)::INT" for k in range(1, 10)) + "{top} AS INTEGER)"


@query(f"WITH {FXS_SQL} SELECT event_id, {EQUAL_SQL.format(top='')} AS bin, {EQUAL_SQL.format(top=' + (p >= 1.0::DOUBLE)::INT')} AS open_bin FROM fxs")
def B_04_equal_width(spark, d):
    return scored_events(spark, d).select("event_id", bins.equal_width_bin(F.col("p")).alias("bin"), bins.equal_width_bin(F.col("p"), closed_top=False).alias("open_bin"))


@query(f"WITH {FXB_SQL} SELECT appointment_id, CASE WHEN n < {SMALL_GROUP} THEN 'OTHER_SMALL' ELSE f.neighbourhood END AS neighbourhood FROM fxb f LEFT JOIN (SELECT neighbourhood, count(*) AS n FROM fxb GROUP BY 1) c ON f.neighbourhood = c.neighbourhood")
def B_05_small_groups(spark, d):
    rows = joins.with_frequency(appointments(spark, d), "neighbourhood", "n")
    return rows.select("appointment_id", bins.small_to_other(F.col("neighbourhood"), F.col("n"), SMALL_GROUP).alias("neighbourhood"))


@query("SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
def T_01_sort(spark, d):
    return read_table(spark, d, "nation").select("n_name", "n_nationkey").orderBy("n_name")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1 ASC, 3 DESC")
def T_02_mixed_sort(spark, d):
    return read_table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.asc("o_orderpriority"), F.desc("n"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 2000")
def T_03_limit(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(2000)


@query(f"WITH {FXS_SQL} SELECT event_id, person_id, label, p FROM fxs ORDER BY p DESC, event_id LIMIT 200")
def T_04_top_n(spark, d):
    return scored_events(spark, d).orderBy(F.desc("p"), "event_id").limit(200).select("event_id", "person_id", "label", "p")


def top_sql(threshold: str) -> str:
    cut = "quantile_cont(p, 1 - f)" if threshold == "quantile" else "min(CASE WHEN r <= k THEN p END)"
    one = "WITH {fx}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, event_id) AS r, count(*) OVER () AS n FROM fxs) ".format(fx=FXS_SQL)
    parts = []
    for f in metrics.TOP_FRACTIONS:
        k = f"greatest(1, floor({f}::DOUBLE * max(n)))"
        body = f"SELECT {f}::DOUBLE AS top_frac, k, sum(CASE WHEN r <= k THEN label ELSE 0 END)::BIGINT AS captured, round(sum(CASE WHEN r <= k THEN label ELSE 0 END) / k::DOUBLE, 6) AS precision_at_k, round({cut.replace('1 - f', repr(1 - f))}, 6) AS threshold FROM r, (SELECT CAST({k} AS BIGINT) AS k FROM r) kk GROUP BY k"
        parts.append(body)
    return one + " UNION ALL ".join(parts)


@query(top_sql("quantile"))
def T_05_top_fractions(spark, d):
    return rounded(metrics.top_fractions(scored_events(spark, d), "event_id"))


@query(f"WITH {FXS_SQL}, r AS (SELECT event_id, row_number() OVER (ORDER BY p DESC, event_id) AS rank, count(*) OVER () AS n FROM fxs) SELECT event_id, rank FROM r WHERE rank <= greatest(1, floor(0.2::DOUBLE * n))")
def T_06_top_rows(spark, d):
    rows = scored_events(spark, d)
    return ordering.global_rank(rows, "p", "event_id").filter(F.col("rank") <= max(1, int(0.2 * rows.count()))).select("event_id", "rank")


@query(f"WITH {FXS_SQL} SELECT round(quantile_cont(p, {1 - 0.1!r}), 6) AS threshold FROM fxs")
def T_07_capacity_threshold(spark, d):
    return rounded(inline(spark, [(metrics.capacity_threshold(scored_events(spark, d), 0.1),)], "threshold double"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer")
def T_08_index_after_sort(spark, d):
    ranked = ordering.global_rank(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")
    return ranked.select("c_custkey", (F.col("rank") - 1).alias("position"))


@query("SELECT * FROM region ORDER BY r_regionkey LIMIT 5")
def T_09_preview(spark, d):
    return read_table(spark, d, "region").orderBy("r_regionkey").limit(5)


# --- scalar functions ----------------------------------------------------------------------------


@query(f"""SELECT o_orderkey, nullif({CODE_SQL}, '?') AS f01, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f02,
  CAST(coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE), DATE '1990-01-01') AS VARCHAR) AS f03, o_orderkey % 365 AS f04,
  CAST(DATE '2008-01-01' + CAST(o_orderkey % 365 AS INTEGER) AS TIMESTAMP) AS f05, CAST(extract('dow' FROM o_orderdate) AS BIGINT) AS f06, CAST(extract('month' FROM o_orderdate) AS BIGINT) AS f07,
  CAST(extract('hour' FROM o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) AS BIGINT) AS f08, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS f09, CAST(date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS f10,
  greatest(-1, least(nullif(o_orderkey % 400, 7), 180)) AS f11, round(ln(1 + greatest(0, nullif(o_orderkey % 400, 7) - 5)), 6) AS f12, {hash_sql('o_orderkey')} AS f13, ({hash_sql('o_orderkey')} % 1000000) / 1000000.0::DOUBLE AS f14,
  CASE WHEN lower(nullif(o_orderpriority, '5-LOW')) = '1-urgent' THEN 1 ELSE 0 END AS f15, replace(lower(trim('  ' || o_orderpriority || ' ')), '-', '_') AS f16, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS f17
  FROM orders""")
def F_01_to_F_17_scalars(spark, d):
    o, key = read_table(spark, d, "orders"), F.col("o_orderkey")
    some = F.nullif(key % 400, F.lit(7).cast("bigint"))
    return rounded(o.select(
        "o_orderkey",
        scalars.unmarked(code_text(key)).alias("f01"),
        scalars.flag(F.col("o_orderstatus") == "F").alias("f02"),
        scalars.date_of(F.when(key % 3 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("1990-01-01")).alias("f03"),
        (key % 365).alias("f04"),
        F.date_add(F.lit(readmission.FIRST_DAY).cast("date"), (key % 365).cast("int")).cast("timestamp_ntz").alias("f05"),
        scalars.day_of_week(F.col("o_orderdate")).alias("f06"),
        scalars.month_of(F.col("o_orderdate")).alias("f07"),
        scalars.hour_of(F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("f08"),
        F.to_date("o_orderdate").alias("f09"),
        scalars.whole_days(F.to_date("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("f10"),
        scalars.clipped(some, -1, 180).alias("f11"),
        scalars.log1p_of(some - 5).alias("f12"),
        scalars.portable_hash(key).alias("f13"),
        scalars.unit_interval(key).alias("f14"),
        scalars.flag(F.lower(F.nullif("o_orderpriority", F.lit("5-LOW"))) == "1-urgent").alias("f15"),
        F.replace(F.lower(F.trim(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))), F.lit("-"), F.lit("_")).alias("f16"),
        scalars.flag(F.col("o_totalprice") > 200000).alias("f17"),
    ))


@query(f"WITH {FXS_SQL}, q AS (SELECT event_id, greatest(1e-15::DOUBLE, least(1.0::DOUBLE - 1e-15::DOUBLE, p)) AS c FROM fxs) SELECT event_id, c AS clipped, round(ln(c / (1 - c)), 4) AS logit, round(1 / (1 + exp(-(0.5 * c + 0.25))), 6) AS squashed, c IS NULL AS is_null FROM q")
def F_18_to_F_20_probabilities(spark, d):
    p = F.col("p")
    rows = scored_events(spark, d).select("event_id", scalars.probability(p).alias("clipped"), F.round(scalars.logit(p), 4).alias("logit"), F.round(scalars.sigmoid(0.5 * scalars.probability(p) + 0.25), 6).alias("squashed"), scalars.probability(p).isNull().alias("is_null"))
    return rows


@query(f"WITH {FXA_SQL} SELECT encounter_id, race IS NULL AS race_missing, num_medications IS NULL AS medications_missing FROM fxa")
def F_24_is_null(spark, d):
    return encounters(spark, d).select("encounter_id", F.col("race").isNull().alias("race_missing"), F.col("num_medications").isNull().alias("medications_missing"))


@query(PRIOR_SQL.format(date="scheduled_date"))
def ST_03_history_when_scheduled(spark, d):
    rows = no_show.features(appointments(spark, d), SMALL_GROUP, as_of="sched_date")
    return rows.select("appointment_id", "prior_appt_count")


# --- medallion -----------------------------------------------------------------------------------


@query(f"WITH {FXA_SQL} SELECT encounter_id, patient_nbr AS person_id, CAST(DATE '2008-01-01' + CAST(encounter_id % 365 AS INTEGER) AS TIMESTAMP) AS t0_date, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS label, time_in_hospital, readmitted FROM fxa")
def TRACK_A_gold(spark, d):
    gold = readmission.gold(readmission.typed(encounters(spark, d)))
    return gold.withColumn("t0_date", F.col("t0_date").cast("timestamp_ntz"))


@query(f"WITH {FXA_SQL} SELECT encounter_id, patient_nbr AS person_id, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS label, time_in_hospital, CAST(num_lab_procedures AS INTEGER) AS num_lab_procedures, CAST(round(num_medications) AS INTEGER) AS num_medications, race, age, admission_source_id FROM fxa")
def TRACK_A_features(spark, d):
    return readmission.features(readmission.silver(encounters(spark, d)))


@query(f"WITH {FXB_SQL} SELECT appointment_id, person_id, scheduled_ts, CAST(scheduled_date AS VARCHAR) AS scheduled_date, CAST(appointment_date AS VARCHAR) AS appointment_date, lead_time_days, 0 AS date_inversion_flag, age, gender, neighbourhood, scholarship, hipertension, sms_received, label FROM fxb WHERE lead_time_days >= 0")
def TRACK_B_gold(spark, d):
    return rounded(no_show.gold(no_show.without_inversions(appointments(spark, d))))


# --- splits --------------------------------------------------------------------------------------


def group_split_sql(share: float, seed: int, source: str, out: str, names=("train", "test")) -> str:
    return f"{out} AS (SELECT person_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql('person_id', f'{seed}:')}, person_id) <= ceil({share}::DOUBLE * count(*) OVER ()) THEN '{names[1]}' ELSE '{names[0]}' END AS part FROM (SELECT DISTINCT person_id FROM {source} WHERE person_id IS NOT NULL) t)"


@query(f"WITH {FXB_SQL}, {group_split_sql(0.2, 42, 'fxb', 's')} SELECT appointment_id, part AS split FROM fxb JOIN s USING (person_id)")
def SPL_01_group_split(spark, d):
    return splits.group_split(appointments(spark, d), "person_id").select("appointment_id", "split")


@query(f"WITH {FXB_SQL}, {group_split_sql(0.2, 42, 'fxb', 'a', ('rest', 'test'))}, rest AS (SELECT person_id FROM a WHERE part = 'rest'), {group_split_sql(0.25, 43, 'rest', 'b', ('train', 'valid'))} SELECT appointment_id, coalesce(b.part, 'test') AS split FROM fxb JOIN a USING (person_id) LEFT JOIN b USING (person_id)")
def SPL_02_three_way_split(spark, d):
    return splits.three_way_split(appointments(spark, d), "person_id").select("appointment_id", "split")


@query(f"WITH {FXB_SQL} SELECT appointment_id, person_id, {split_sql('person_id')} AS split FROM fxb")
def SPL_03_hash_split(spark, d):
    return splits.hash_split(appointments(spark, d), "person_id").select("appointment_id", "person_id", "split")


@query(f"WITH {FXB_SQL} SELECT appointment_id, CAST({hash_sql('person_id')} % 5 AS INTEGER) AS fold FROM fxb")
def SPL_04_group_folds(spark, d):
    return splits.group_folds(appointments(spark, d), "person_id").select("appointment_id", "fold")


BOOT_SQL = f"""
WITH {FXS_SQL}, {picks_sql(DRAWS)}, per AS (SELECT draw, p, sum(weight * label)::DOUBLE AS pos, sum(weight)::DOUBLE AS n FROM fxs JOIN w USING (person_id) GROUP BY draw, p),
cum AS (SELECT *, sum(pos) OVER c AS tp, sum(n) OVER c AS seen, sum(pos) OVER (PARTITION BY draw) AS ap, sum(n) OVER (PARTITION BY draw) AS an FROM per WINDOW c AS (PARTITION BY draw ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT draw, round(sum(pos * tp / seen) / max(ap), 6) AS pr_auc, round(sum(pos * ((an - ap) - (seen - tp) + (n - pos) / 2)) / max(ap * (an - ap)), 6) AS roc_auc,
       sum(n)::BIGINT AS n, round(sum(pos) / sum(n), 6) AS prevalence, round(sum(n * p) / sum(n), 6) AS mean_p, round(sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / sum(n), 6) AS brier,
       round(-sum(pos * ln(greatest(1e-15::DOUBLE, least(1.0::DOUBLE - 1e-15::DOUBLE, p))) + (n - pos) * ln(1 - greatest(1e-15::DOUBLE, least(1.0::DOUBLE - 1e-15::DOUBLE, p)))) / sum(n), 6) AS logloss
FROM cum GROUP BY draw
"""


@query(BOOT_SQL)
def SPL_05_cluster_bootstrap(spark, d):
    return rounded(splits.cluster_bootstrap(scored_events(spark, d), "person_id", draws=DRAWS))


@query(f"WITH {FXB_SQL}, {group_split_sql(0.2, 42, 'fxb', 'a', ('rest', 'test'))}, rest AS (SELECT person_id FROM a WHERE part = 'rest'), {group_split_sql(0.25, 43, 'rest', 'b', ('train', 'valid'))} SELECT coalesce(b.part, 'test') AS split, count(*) AS rows, count(DISTINCT person_id) AS people, round(avg(label), 6) AS prevalence FROM fxb JOIN a USING (person_id) LEFT JOIN b USING (person_id) GROUP BY 1")
def SPL_06_split_quality(spark, d):
    return rounded(splits.split_quality(splits.three_way_split(appointments(spark, d), "person_id"), "person_id", "label"))


@query(f"WITH {FXB_SQL} SELECT appointment_id, label FROM fxb WHERE {split_sql('person_id')} = 'valid'")
def SPL_08_stored_split(spark, d):
    return splits.hash_split(appointments(spark, d), "person_id").filter("split = 'valid'").select("appointment_id", "label")


# --- metrics and curves --------------------------------------------------------------------------

AUC_SQL = "sum(pos * ((all_n - all_pos) - (seen - tp) + (n - pos) / 2)) / max(all_pos * (all_n - all_pos))"
CLIP_SQL = "greatest(1e-15::DOUBLE, least(1.0::DOUBLE - 1e-15::DOUBLE, p))"


@query(f"WITH {CUM_SQL} SELECT round(sum(pos * tp / seen) / max(all_pos), 6) AS pr_auc FROM cum")
def M_01_average_precision(spark, d):
    return rounded(metrics.ranking_metrics(scored_events(spark, d), "label", "p").select("pr_auc"))


@query(f"WITH {CUM_SQL} SELECT round({AUC_SQL}, 6) AS roc_auc FROM cum")
def M_02_roc_auc(spark, d):
    return rounded(metrics.ranking_metrics(scored_events(spark, d), "label", "p").select("roc_auc"))


@query(f"WITH {FXS_SQL} SELECT round(avg((p - label) * (p - label)), 6) AS brier FROM fxs")
def M_03_brier(spark, d):
    return rounded(scored_events(spark, d).agg(metrics.brier("label", "p").alias("brier")))


@query(f"WITH {FXS_SQL} SELECT round(-avg(label * ln({CLIP_SQL}) + (1 - label) * ln(1 - {CLIP_SQL})), 6) AS logloss FROM fxs")
def M_04_log_loss(spark, d):
    return rounded(scored_events(spark, d).agg(metrics.log_loss("label", "p").alias("logloss")))


@query(f"WITH {FXS_SQL} SELECT round(avg(label), 6) AS prevalence, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p FROM fxs")
def M_05_prevalence_and_centre(spark, d):
    rows = scored_events(spark, d)
    return rounded(rows.agg(F.avg("label").alias("prevalence"), F.avg("p").alias("mean_p"), F.lit(ordering.quantiles(rows, "p", [0.5])[0]).alias("median_p")))


ECE_SQL = "SELECT round(sum(CASE WHEN b < 10 THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS {name} FROM (SELECT {bin} AS b, count(*) AS n, avg(label) AS acc, avg(p) AS conf FROM fxs GROUP BY 1) t"


@query(f"WITH {FXS_SQL} SELECT * FROM ({ECE_SQL.format(name='ece', bin=EQUAL_SQL.format(top=''))}) a, ({ECE_SQL.format(name='ece_open', bin=EQUAL_SQL.format(top=' + (p >= 1.0::DOUBLE)::INT'))}) b")
def M_06_calibration_error(spark, d):
    rows = scored_events(spark, d)
    closed, open_ = (metrics.expected_calibration_error(rows, closed_top=c).withColumnRenamed("ece", n) for c, n in ((True, "ece"), (False, "ece_open")))
    return rounded(closed.crossJoin(open_))


@query(f"WITH {FXS_SQL} SELECT sum(CASE WHEN p >= 0.5 THEN label ELSE 0 END)::BIGINT AS tp, sum((p >= 0.5)::INT)::BIGINT AS flagged, round(sum(CASE WHEN p >= 0.5 THEN label ELSE 0 END) / sum((p >= 0.5)::INT)::DOUBLE, 6) AS precision, round(sum(CASE WHEN p >= 0.5 THEN label ELSE 0 END) / sum(label)::DOUBLE, 6) AS recall, round(avg((p >= 0.5)::INT), 6) AS flagged_fraction FROM fxs")
def M_07_precision_recall_at_threshold(spark, d):
    return rounded(metrics.threshold_metrics(scored_events(spark, d), 0.5))


@query(top_sql("kth"))
def M_08_top_fraction_kth(spark, d):
    return rounded(metrics.top_fractions(scored_events(spark, d), "event_id", threshold="kth"))


CI_COLUMNS = ["prevalence", "brier", "logloss", "pr_auc", "roc_auc"]


@query(f"WITH m AS ({BOOT_SQL}), points AS (SELECT * FROM (WITH {CUM_SQL} SELECT sum(pos * tp / seen) / max(all_pos) AS pr_auc, {AUC_SQL} AS roc_auc FROM cum) a, (WITH {FXS_SQL} SELECT avg(label) AS prevalence, avg((p - label) * (p - label)) AS brier, -avg(label * ln({CLIP_SQL}) + (1 - label) * ln(1 - {CLIP_SQL})) AS logloss FROM fxs) b) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round((SELECT {c} FROM points), 5) AS point_estimate, round(quantile_cont({c}, 0.025), 5) AS ci95_low, round(quantile_cont({c}, 0.975), 5) AS ci95_high FROM m" for c in CI_COLUMNS))
def M_09_bootstrap_intervals(spark, d):
    rows = scored_events(spark, d)
    draws = rounded(splits.cluster_bootstrap(rows, "person_id", draws=DRAWS))
    return rounded(splits.intervals(draws, metrics.evaluate(rows), CI_COLUMNS), 5)


INTERVAL_COLUMNS = ["pr_auc", "roc_auc", "brier", "logloss", *[f"{m}_top_{f * 100:g}" for m in ("prec", "captured") for f in metrics.TOP_FRACTIONS]]


@query()
def M_09_all_intervals(spark, d):
    """All metrics of the reference's table, with the operators' own 500 draws."""
    rows = scored_events(spark, d)
    draws = splits.cluster_bootstrap(rows, "person_id", fractions=metrics.TOP_FRACTIONS)
    top = splits.weighted_top(rows.withColumns({"draw": F.lit(0), "weight": F.lit(1)})).drop("draw")
    return rounded(splits.intervals(draws, metrics.evaluate(rows).crossJoin(top), INTERVAL_COLUMNS), 5)


@query(f"WITH {FXS_SQL} SELECT round(avg(p), 6) AS mean, round(median(p), 6) AS median, " + ", ".join(f"round(quantile_cont(p, {s}), 6) AS {n}" for n, s in metrics.QUANTILES.items()) + " FROM fxs")
def M_10_distribution(spark, d):
    return rounded(metrics.distribution(scored_events(spark, d)))


@query(f"WITH {CUM_SQL} SELECT score AS threshold, round(tp / seen, 6) AS precision, round(tp / all_pos, 6) AS recall FROM cum UNION ALL SELECT NULL, 1.0, 0.0")
def C_01_precision_recall_curve(spark, d):
    return metrics.precision_recall_curve(scored_events(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"WITH {CUM_SQL} SELECT score AS threshold, round((seen - tp) / (all_n - all_pos), 6) AS fpr, round(tp / all_pos, 6) AS tpr FROM cum UNION ALL SELECT NULL, 0.0, 0.0")
def C_02_roc_curve(spark, d):
    return metrics.roc_curve(scored_events(spark, d)).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query(f"WITH {DECILE_SQL} SELECT risk_decile, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS observed, count(*) AS n FROM dec GROUP BY 1")
def C_03_reliability(spark, d):
    return rounded(metrics.reliability(scored_events(spark, d)))


@query(GAINS_SQL)
def C_04_cumulative_gains(spark, d):
    return rounded(metrics.cumulative_gains(scored_events(spark, d), "event_id"))


@query(f"WITH {DECILE_SQL} SELECT event_id, row_number() OVER (ORDER BY p DESC, event_id) AS rank, risk_decile FROM dec")
def APP_04_rank_and_decile(spark, d):
    from outrider.scoring import ranked

    return ranked(scored_events(spark, d), "event_id", "p").select("event_id", "rank", "risk_decile")


@query(f"WITH {FXA_SQL} SELECT encounter_id, patient_nbr AS person_id, time_in_hospital, race FROM fxa ORDER BY encounter_id LIMIT 2000")
def APP_06_scoring_input(spark, d):
    rows = readmission.features(encounters(spark, d)).drop("label")
    return rows.orderBy("encounter_id").limit(2000).select("encounter_id", "person_id", "time_in_hospital", "race")


@query(f"WITH {FXA_SQL} SELECT encounter_id, round((coalesce(num_medications, m) - avg(coalesce(num_medications, m)) OVER ()) / stddev_pop(coalesce(num_medications, m)) OVER (), 5) AS scaled, coalesce(race, r) AS race, (race IS NULL)::DOUBLE AS race_missing FROM fxa, (SELECT median(num_medications) AS m FROM fxa) a, (SELECT race AS r FROM fxa WHERE race IS NOT NULL GROUP BY race ORDER BY count(*) DESC, race LIMIT 1) b")
def ML_01_to_ML_05_preparation(spark, d):
    from outrider.contract import Contract
    from outrider.operators.models import Preparation

    rows = encounters(spark, d).select("encounter_id", "num_medications", "race")
    contract = Contract(["encounter_id"], ["num_medications", "race"], ["num_medications"], ["race"])
    ready = Preparation.fit(rows, contract, indicators=True).apply(rows)
    return ready.select("encounter_id", F.round("_x_num_medications", 5).alias("scaled"), F.col("_c_race").alias("race"), F.col("_m_race").alias("race_missing"))


def _readmission_model(spark: SparkSession, d: str):
    from outrider.contract import Contract

    def stored(df):
        path = shared_folder(spark)
        df.write.parquet(path)
        return spark.read.parquet(path)

    # the split reads its rows many times and so do the fits; as tables, they aren't planned anew with all that is before them
    rows = stored(readmission.features(readmission.silver(encounters(spark, d))))
    numbers, kinds = ["time_in_hospital", "num_lab_procedures", "num_medications"], ["race", "age", "admission_source_id"]
    return stored(splits.three_way_split(rows, "person_id")).persist(), Contract(["encounter_id", "person_id"], [*numbers, *kinds], numbers, kinds, "label")


@query()
def ML_08_logistic_scores(spark, d):
    """Every encounter scored by logistic regression of the training split."""
    from outrider.operators import models

    rows, contract = _readmission_model(spark, d)
    train = rows.filter("split = 'train'")
    return models.Model.fit(train, contract, models.logistic(train.count())).score(rows).select("encounter_id", "split", "label", "p_raw")


@query()
def ML_09_balanced_logistic(spark, d):
    """The same with both classes weighing alike."""
    from outrider.operators import models

    rows, contract = _readmission_model(spark, d)
    train = models.balanced_weights(rows.filter("split = 'train'"))
    return models.Model.fit(train, contract, models.logistic(train.count(), weight="_weight")).score(rows).select("encounter_id", "split", "label", "p_raw")


@query()
def ML_13_cross_fitted_platt(spark, d):
    """Test encounters with raw and calibrated scores, the calibration fitted out of fold."""
    from outrider.operators import models

    rows, contract = _readmission_model(spark, d)
    train = splits.group_folds(rows.filter("split <> 'test'"), "person_id")
    model, platt = models.cross_fitted(train, contract, lambda seen: models.logistic(seen.count()))
    return model.score(rows.filter("split = 'test'")).select("encounter_id", "label", "p_raw", platt.apply(F.col("p_raw")).alias("p_hat"))


@query()
def ML_14_isotonic(spark, d):
    """Scores calibrated by a step curve."""
    from outrider.operators import models

    rows = scored_events(spark, d)
    return models.isotonic(rows, "p")(rows).select("event_id", "label", "p", "p_iso")


@query()
def ML_17_leaderboard(spark, d):
    """Four kinds of model, ranked on the validation split, with the operators' own 400 trees and 400 rounds."""
    from outrider.operators import models

    rows, contract = _readmission_model(spark, d)
    parts = [rows.filter(F.col("split") == s).cache() for s in ("train", "valid", "test")]
    made = {"logistic": lambda seen: models.logistic(seen.count()), "tree": lambda _: models.tree(), "forest": lambda _: models.forest(), "boosting": lambda _: models.boosting()}
    return models.leaderboard(*parts, contract, made, "encounter_id")[0]
