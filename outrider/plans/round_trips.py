"""Queries of sources, sinks, contracts and reports: what is written is read back, what is refused is told."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outrider.contract import Contract, Validated, features_of, fingerprint, require_columns, validate
from outrider.functions.scalars import normalise_name, quote_ident
from outrider.operators import splits
from outrider.plans.catalog import CODE_SQL, code_text, group_split_sql, rounded
from outrider.plans.fixtures import FXA_SQL, FXB_SQL, FXS_SQL, appointments, scored_events
from outrider.plans.registry import query
from outrider.scoring import AUDIT, run_id, summary
from outrider.session import shared_folder
from outrider.sources import readers, writers
from outrider.sources.readers import inline, read_table, registered

NOTE_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a \"quoted\", part' ELSE o_orderpriority END"


def _noted(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, 'a "quoted", part').otherwise(F.col("o_orderpriority"))
    return read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", note.alias("note"))


def _name(label: str) -> str:
    return f"outrider_{label}_{uuid.uuid4().hex}"


def _taken(table: DataFrame, name: str) -> DataFrame:
    """The rows of a table of fixed size, which goes."""
    out = table.sparkSession.createDataFrame(table.collect(), table.schema)
    table.sparkSession.sql(f"DROP TABLE {name}")
    return out


def _folder(spark: SparkSession) -> Path:
    """A shared folder that the driver writes its own small files to."""
    found = shared_folder(spark)
    if not found.startswith(("file:", "/")):
        raise ValueError(f"{found} is no mounted folder")
    folder = Path("/" + found.removeprefix("file:").lstrip("/"))
    folder.mkdir(parents=True)
    return folder


def _refusals(spark: SparkSession, tries: dict[str, Callable[[], object]]) -> DataFrame:
    told = []
    for name, attempt in tries.items():
        try:
            attempt()
            told.append((name, None))
        except (ValueError, FileNotFoundError) as error:
            told.append((name, str(error)))
    return inline(spark, told, "attempt string, refusal string")


# --- sources -------------------------------------------------------------------------------------


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, {NOTE_SQL} AS note FROM orders")
def SRC_01_text_columns(spark, d):
    path = shared_folder(spark)
    writers.write_csv(_noted(spark, d), path)
    return readers.read_text_columns(spark, path)


@query(f"SELECT o_orderkey, {CODE_SQL} AS code, TRY_CAST({CODE_SQL} AS DOUBLE) AS amount FROM orders")
def SRC_02_typed_text(spark, d):
    """Codes stay text, amounts that are no numbers are NULL."""
    path, code = shared_folder(spark), code_text(F.col("o_orderkey"))
    writers.write_csv(read_table(spark, d, "orders").select("o_orderkey", code.alias("code"), code.alias("amount")), path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("code", T.StringType()), T.StructField("amount", T.DoubleType())])
    return readers.read_typed(spark, path, schema)


@query("SELECT count(*) AS rows, count(*) AS stamped, 1::BIGINT AS moments FROM orders")
def SRC_03_ingest_time(spark, d):
    path = shared_folder(spark)
    writers.write_csv(_noted(spark, d), path)
    return readers.bronze(spark, path).agg(F.count("*").alias("rows"), F.count("ingest_ts").alias("stamped"), F.count_distinct("ingest_ts").alias("moments"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def SRC_08_registered_relation(spark, d):
    registered(read_table(spark, d, "customer"), "outrider_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM outrider_customers GROUP BY c_mktsegment")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def SRC_09_host_variable(spark, d):
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM {nations} GROUP BY n_regionkey", nations=read_table(spark, d, "nation"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def SRC_10_bound_parameters(spark, d):
    registered(read_table(spark, d, "orders"), "outrider_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM outrider_orders WHERE o_orderstatus = ? AND o_totalprice > ?", args=["F", 1000])


@query("SELECT * FROM (VALUES ('outrider_listed_a'), ('outrider_listed_b')) t(name)")
def SRC_11_catalog_listing(spark, d):
    for name in ("outrider_listed_b", "outrider_listed_a"):
        registered(read_table(spark, d, "region"), name)
    return inline(spark, [(n,) for n in readers.table_names(spark) if n.startswith("outrider_listed_")], "name string")


@query("SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type, true AS nullable FROM (DESCRIBE SELECT * FROM customer)")
def SRC_12_schema(spark, d):
    return inline(spark, readers.table_info(read_table(spark, d, "customer")), "name string, type string, nullable boolean")


ROLES = Contract(["appointment_id", "person_id"], ["age", "lead_time_days", "gender"], ["age", "lead_time_days"], ["gender"])


@query("SELECT * FROM (VALUES ('age', 'number'), ('lead_time_days', 'number'), ('gender', 'category')) t(feature, role)")
def SRC_14_contract_file(spark, d):
    """A contract written as JSON and loaded again."""
    path = _folder(spark) / "contract.json"
    ROLES.save(path)
    held = Contract.load(path)
    return inline(spark, [(c, "number" if c in held.numeric_cols else "category") for c in held.feature_cols], "feature string, role string")


@query("SELECT * FROM (VALUES ('first existing', 'b'), ('root', 'top'), ('model', 'artifacts/model')) t(what, place)")
def SRC_15_to_SRC_18_paths(spark, d):
    top = _folder(spark) / "top"
    (top / "b" / "c").mkdir(parents=True)
    (top / ".marker").touch()
    found = readers.first_existing([top / "a", top / "b", top / "b" / "c"])
    readers.require_all([found, top])
    root = readers.find_root(found / "c", (".marker",))
    return inline(spark, [("first existing", found.name), ("root", root.name), ("model", str(readers.Paths(root).model.relative_to(root)))], "what string, place string")


@query("SELECT count(*) AS n FROM lineitem")
def SRC_19_scalar(spark, d):
    return inline(spark, [(readers.scalar(read_table(spark, d, "lineitem").agg(F.count("*"))),)], "n bigint")


# --- sinks ---------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def SNK_01_replaced_table(spark, d):
    """The second of two tables of the same name."""
    name, nation = _name("replaced"), read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.replace_table(nation, name)
    return _taken(writers.replace_table(nation.filter("n_regionkey = 2").drop("n_regionkey"), name), name)


@query("SELECT * FROM nation WHERE n_regionkey <> 1")
def SNK_02_table_replaced_from_itself(spark, d):
    name = _name("itself")
    writers.replace_table(read_table(spark, d, "nation"), name)
    return _taken(writers.replace_stored(spark.table(name).filter("n_regionkey <> 1"), name), name)


@query("SELECT r_name FROM region")
def SNK_03_replaced_view(spark, d):
    writers.replace_view(read_table(spark, d, "nation").select("n_name"), "outrider_view")
    writers.replace_view(read_table(spark, d, "region").select("r_name"), "outrider_view")
    return spark.table("outrider_view")


@query("SELECT * FROM (VALUES ('run_20240102_030405', 'score', 3::BIGINT, '[\"a\", \"b\"]'), ('run_20240102_030406', 'evaluate', 4::BIGINT, '[]')) t(run_id, mode, rows_scored, warnings_json)")
def SNK_05_run_audit(spark, d):
    """Two runs in a table that the first one makes."""
    name = _name("audit")
    for second, mode, n, warnings in ((5, "score", 3, ["a", "b"]), (6, "evaluate", 4, [])):
        now = datetime(2024, 1, 2, 3, 4, second)
        writers.append_row(spark, name, AUDIT, (run_id(now), now.isoformat(timespec="seconds"), "in.csv", mode, n, "", json.dumps(warnings)))
    return _taken(spark.table(name).select("run_id", "mode", "rows_scored", "warnings_json"), name)


@query(f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) AS index, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, {NOTE_SQL} AS note FROM orders")
def SNK_06_csv_with_index(spark, d):
    path = shared_folder(spark)
    writers.write_csv(_noted(spark, d), path, index_by="o_orderkey")
    return readers.read_text_columns(spark, path)


@query("""SELECT * FROM (VALUES (1, '# Model card'), (2, ''), (3, '## Data'), (4, ''), (5, 'All orders.'), (6, ''), (7, '## Scores'), (8, ''), (9, '| part | rate |'), (10, '|---|---|'), (11, '| test | 0.2500 |'), (12, ''), (13, 'run one'), (14, 'rows 3')) t(line, content)""")
def SNK_08_SNK_09_report_and_log(spark, d):
    folder = _folder(spark)
    writers.write_report(folder / "card.md", "Model card", {"Data": "All orders.", "Scores": [{"part": "test", "rate": 0.25}]})
    writers.write_log(folder / "run.log", ["run one", "rows 3"])
    lines = (folder / "card.md").read_text().split("\n") + (folder / "run.log").read_text().splitlines()
    return inline(spark, list(enumerate(lines, 1)), "line int, content string")


@query(f"WITH {FXA_SQL} SELECT count(*) AS rows, 0::BIGINT AS differing FROM fxa")
def SNK_11_model_reload(spark, d):
    """A model scores as before once it has been saved and loaded."""
    from outrider.operators import models
    from outrider.plans.catalog import _readmission_model

    rows, contract = _readmission_model(spark, d)
    train = rows.filter("split = 'train'")
    model, path = models.Model.fit(train, contract, models.logistic(train.count())), shared_folder(spark)
    model.save(path)
    both = models.Model.load(spark, path).score(model.score(rows, "p_before"), "p_after")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("p_before") - F.col("p_after")) > 1e-12).alias("differing"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def SNK_14_records(spark, d):
    held = writers.records(read_table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return inline(spark, [(r["n_regionkey"], r["n"]) for r in held], "n_regionkey int, n bigint")


# --- names ---------------------------------------------------------------------------------------


@query("SELECT n_name, n_regionkey + 1 AS next FROM nation")
def PRJ_03_quoted_identifier(spark, d):
    odd = "region `key`, 100 %"
    registered(read_table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias(odd)), "outrider_odd_names")
    return spark.sql(f"SELECT n_name, {quote_ident(odd)} + 1 AS next FROM outrider_odd_names")


@query("SELECT given, replace(replace(lower(trim(given)), ' ', '_'), '-', '_') AS name FROM (VALUES (' No-show '), ('Appointment ID'), ('age')) t(given)")
def PRJ_06_normalised_names(spark, d):
    return inline(spark, [(n, normalise_name(n)) for n in (" No-show ", "Appointment ID", "age")], "given string, name string")


@query("SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM orders) WHERE column_name NOT IN ('o_orderkey', 'o_custkey')")
def PRJ_13_feature_columns(spark, d):
    return inline(spark, [(c,) for c in features_of(read_table(spark, d, "orders").columns, ["o_orderkey", "o_custkey"])], "feature string")


# --- validation ----------------------------------------------------------------------------------

GIVEN_SQL = "SELECT appointment_id, person_id, CASE WHEN appointment_id % 9 = 0 THEN 'unknown' ELSE CAST(age AS VARCHAR) END AS age, CASE WHEN appointment_id % 3 = 0 THEN NULL ELSE lead_time_days END AS lead_time_days, gender, CASE WHEN appointment_id % 50 = 0 THEN 'yes' ELSE CAST(label AS VARCHAR) END AS label FROM fxb"


def _validated(spark: SparkSession, d: str) -> Validated:
    key = F.col("appointment_id")
    rows = appointments(spark, d).select(
        "appointment_id",
        "person_id",
        F.when(key % 9 == 0, "unknown").otherwise(F.col("age").cast("string")).alias("age"),
        F.when(key % 3 == 0, None).otherwise(F.col("lead_time_days")).alias("lead_time_days"),
        "gender",
        F.when(key % 50 == 0, "yes").otherwise(F.col("label").cast("string")).alias("label"),
        F.lit(1).alias("readmitted"),
        F.lit("x").alias("comment"),
    )
    return validate(rows, ROLES, "evaluate")


@query(f"WITH {FXB_SQL} SELECT appointment_id, person_id, TRY_CAST(age AS DOUBLE) AS age, CAST(lead_time_days AS DOUBLE) AS lead_time_days, gender, TRY_CAST(label AS DOUBLE) AS label FROM ({GIVEN_SQL})")
def VAL_06_validated_rows(spark, d):
    """Ids, features and label in their types; leaking and unknown columns are gone."""
    return _validated(spark, d).rows


@query(f"""WITH {FXB_SQL}, given AS ({GIVEN_SQL})
SELECT 'columns that leak the label, dropped: [''readmitted'']' AS warning
UNION ALL SELECT 'unknown columns, ignored: [''comment'']'
UNION ALL SELECT 'features missing in more than a quarter of the rows: [''lead_time_days'']' FROM given HAVING avg(CASE WHEN lead_time_days IS NULL THEN 1.0 ELSE 0.0 END) > 0.25
UNION ALL SELECT count(*) || ' labels are missing or not numeric' FROM given WHERE TRY_CAST(label AS DOUBLE) IS NULL HAVING count(*) > 0""")
def VAL_03_to_VAL_08_warnings(spark, d):
    return inline(spark, [(w,) for w in _validated(spark, d).warnings], "warning string")


@query("SELECT md5('appointment_id:bigint|person_id:bigint|age:double|lead_time_days:double|gender:string|label:double') AS schema_hash, md5('r_regionkey:int|r_name:string') AS region_hash")
def VAL_09_fingerprint(spark, d):
    return inline(spark, [(_validated(spark, d).schema_hash, fingerprint(read_table(spark, d, "region")))], "schema_hash string, region_hash string")


@query("""SELECT * FROM (VALUES ('mode', 'mode is score or evaluate'), ('ids', 'missing id columns: [''person_id'']'), ('label', 'evaluate needs the column label'),
('features', 'missing features: [''age'']'), ('all there', NULL)) t(attempt, refusal)""")
def VAL_01_to_VAL_04_refusals(spark, d):
    rows = appointments(spark, d)
    bare = rows.drop("label")
    return _refusals(spark, {
        "mode": lambda: validate(rows, ROLES, "guess"),
        "ids": lambda: validate(rows.drop("person_id"), ROLES),
        "label": lambda: validate(bare, ROLES, "evaluate"),
        "features": lambda: validate(rows.drop("age"), ROLES),
        "all there": lambda: validate(bare, ROLES),
    })


@query("""SELECT * FROM (VALUES ('required', 'missing columns: [''absent'']'), ('superset', 'roles for columns that are no features: [''lead'']'),
('treatment', 'the treatment_col sms_received is among the features'), ('label', 'the label_col label is among the features')) t(attempt, refusal)""")
def FLT_11_to_FLT_13_refusals(spark, d):
    rows = appointments(spark, d)
    return _refusals(spark, {
        "required": lambda: require_columns(rows, ["age", "absent"]),
        "superset": lambda: Contract(["appointment_id"], ["age"], ["age", "lead"], []),
        "treatment": lambda: Contract(["appointment_id"], ["age", "sms_received"], ["age"], [], treatment_col="sms_received"),
        "label": lambda: Contract(["appointment_id"], ["age", "label"], ["age"], [], label_col="label"),
    })


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM nation)")
def FLT_10_denied_columns(spark, d):
    """What is left of a table with leaking columns, its features being all it has."""
    nation = read_table(spark, d, "nation")
    contract = Contract(["n_nationkey"], ["n_name", "n_regionkey"], ["n_regionkey"], ["n_name"])
    held = validate(nation.withColumns({"outcome": F.lit(1), "target": F.lit(0)}), contract)
    return inline(spark, [(c,) for c in held.rows.columns], "name string")


# --- reports -------------------------------------------------------------------------------------


@query(f"WITH {FXB_SQL}, {group_split_sql(0.2, 42, 'fxb', 'a')} SELECT part AS split, count(*) AS rows, count(DISTINCT person_id) AS people, round(avg(label), 6) AS prevalence, 0::BIGINT AS straddling FROM fxb JOIN a USING (person_id) GROUP BY part")
def SPL_07_split_manifest(spark, d):
    told = splits.manifest(splits.group_split(appointments(spark, d), "person_id"), "person_id", "label")
    rows = [(s, p["rows"], p["people"], p["prevalence"], told["straddling"]) for s, p in told["parts"].items()]
    return rounded(inline(spark, rows, "split string, rows bigint, people bigint, prevalence double, straddling bigint"))


@query(f"WITH {FXS_SQL} SELECT count(*) AS rows, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(avg((p - label) * (p - label)), 6) AS brier, 4::BIGINT AS tops FROM fxs")
def APP_05_summary(spark, d):
    rows = scored_events(spark, d).withColumnRenamed("p", "p_hat")
    told = summary(rows, Validated(rows, rows, [], "", True), "run", "evaluate", "events", {}, "event_id")
    spread = told["probability_distribution"]
    return rounded(inline(spark, [(told["rows"], spread["mean"], spread["median"], told["metrics"]["brier"], len(told["topk_metrics"]))], "rows bigint, mean double, median double, brier double, tops bigint"))
