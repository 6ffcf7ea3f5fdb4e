import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outrider.contract import Contract, features_of, fingerprint, validate
from outrider.operators import models, profile, splits
from outrider.plans import appointments, encounters
from outrider.scoring import ranked, run_id, score_file
from outrider.sources import readers, writers
from outrider.streaming.scoring import event_rates, score_stream


def test_appointments_from_text_to_features(spark, tmp_path):
    head = "PatientId,AppointmentID,Gender,ScheduledDay,AppointmentDay,Age,Neighbourhood,Scholarship,SMS_received,No-show"
    lines = [
        "1.0,10,F,2016-04-29T18:38:08Z,2016-05-02T00:00:00Z,62,A,0,1,No",
        "1.0,11,F,2016-04-29T08:00:00Z,2016-05-03T00:00:00Z,62,A,0,0,Yes",
        "2.0,12,M,2016-05-05T10:00:00Z,2016-05-02T00:00:00Z,30,B,1,0,No",
        "3.0,13,M,,2016-05-02T00:00:00Z,,B,1,0,yes",
        "4.0,14,M,2016-04-29T08:00:00Z,2016-05-03T00:00:00Z,140,B,1,0,No",
        ",,M,2016-04-29T08:00:00Z,2016-05-03T00:00:00Z,40,B,1,0,No",
    ]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([head, *lines]))
    raw = readers.bronze(spark, str(path))
    assert {t for c, t in raw.dtypes if c != "ingest_ts"} == {"string"}
    silver = appointments.silver(raw)
    assert silver.count() == 5
    clean = appointments.gold(appointments.without_inversions(silver))
    rows = {r.appointment_id: r for r in clean.collect()}
    assert sorted(rows) == [10, 11, 13]
    assert (rows[10].lead_time_days, rows[10].label, rows[11].label, rows[13].lead_time_days, rows[13].label) == (3, 0, 1, None, 1)
    got = {r.appointment_id: r for r in appointments.features(clean, small=2).collect()}
    assert len(got) == 3
    assert (got[10].prior_appt_count, got[11].prior_appt_count) == (0, 1)
    assert (got[13].lead_time_bin, got[13].lead_time_clipped, got[13].neighbourhood, got[13].sched_hour) == ("61_plus", 180, "OTHER_SMALL", None)
    assert (got[10].sched_hour, got[10].appt_dow) == (18, 1)
    kept = {r.appointment_id: r for r in appointments.features(clean, null_lead="propagate").collect()}
    assert kept[13].lead_time_bin is None and kept[13].lead_time_clipped is None
    with pytest.raises(ValueError, match="no_show"):
        appointments.silver(raw.drop("No-show"))


def test_encounters_from_text(spark):
    bronze = spark.createDataFrame([("1", "7", "3", "<30", "?"), ("2", "7", "x", "NO", "A"), (None, "8", "1", "NO", "B")], "encounter_id string, patient_nbr string, time_in_hospital string, readmitted string, race string")
    silver = encounters.silver(bronze)
    rows = {r.encounter_id: r for r in encounters.features(silver).collect()}
    assert (rows[1].label, rows[1].race, rows[2].time_in_hospital, sorted(rows)) == (1, None, None, [1, 2])
    gold = encounters.gold(encounters.typed(silver.filter("encounter_id = 1"))).first()
    assert gold.t0_date == datetime(2008, 1, 2) and gold.label == 1


CONTRACT = Contract(["encounter_id", "label"], ["x", "kind"], ["x"], ["kind"])


def test_validation(spark):
    df = spark.createDataFrame([("1", "1.5", None, "1", "0", "z"), ("2", "bad", None, "x", "0", "z")], "encounter_id string, x string, kind string, label string, outcome string, other string")
    held = validate(df, CONTRACT, "evaluate")
    assert held.rows.columns == ["encounter_id", "x", "kind", "label"]
    assert [r.x for r in held.rows.collect()] == [1.5, None]
    text = " ".join(held.warnings)
    assert "outcome" in text and "other" in text and "kind" in text and "1 labels" in text
    assert held.schema_hash == fingerprint(held.rows) and len(held.schema_hash) == 32
    for bad, mode, match in ((df.drop("encounter_id"), "score", "encounter_id"), (df.drop("x"), "score", "x"), (df.drop("label"), "evaluate", "label"), (df, "guess", "mode")):
        with pytest.raises(ValueError, match=match):
            validate(bad, CONTRACT, mode)
    with pytest.raises(ValueError, match="treatment"):
        Contract(["id"], ["a", "t"], ["a"], [], treatment_col="t")
    assert features_of(["a", "id", "b"], ["id"]) == ["a", "b"]


def test_missingness(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 0), (3, "a", 0)], "k int, c string, label int")
    assert [tuple(r) for r in profile.missingness(df, ["k", "c"]).collect()] == [("k", 0, 0.0), ("c", 2, pytest.approx(2 / 3))]
    assert [tuple(r) for r in profile.missingness(df.limit(0), ["c"]).collect()] == [("c", 0, 0.0)] or profile.missingness(df.limit(0), ["c"]).first().missing_rate == 0.0
    assert [r["column"] for r in profile.missing_against_label(df, ["k", "c"], "label").collect()] == ["c"]
    assert profile.missing_against_label(df, ["k", "c"], "label", keep_complete=True).count() == 2


def rows_for_models(spark, n=600):
    random.seed(7)
    made = []
    for k in range(n):
        x, kind = random.gauss(0, 1), random.choice("abc")
        made.append((k, k % 90, int(random.random() < 1 / (1 + 2.718 ** -(1.5 * x + (kind == "a") - 1))), x if k % 17 else None, kind if k % 13 else None))
    return spark.createDataFrame(made, "encounter_id bigint, person bigint, label int, x double, kind string").cache()


def test_score_file_end_to_end(spark, tmp_path):
    df = splits.group_folds(rows_for_models(spark), "person", 2)
    model, platt = models.cross_fitted(df, CONTRACT, lambda seen: models.logistic(seen.count()), 2)
    root = tmp_path / "root"
    (root / "artifacts").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        score_file(spark, root, "none.csv")
    model.save(str(root / "artifacts" / "model"))
    CONTRACT.save(root / "artifacts" / "contract.json")
    platt.save(root / "artifacts" / "calibration.json")
    again = models.Model.load(spark, str(root / "artifacts" / "model"))
    a, b = ({r.encounter_id: r.p_raw for r in m.score(df).collect()} for m in (model, again))
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    source = str(tmp_path / "in")
    df.select("encounter_id", "x", "kind", "label").coalesce(1).write.option("header", True).csv(source)
    told = score_file(spark, root, source, tmp_path / "out", fractions=(0.1,))
    assert told["mode"] == "evaluate" and told["rows"] == 600 and told["metrics"]["roc_auc"] > 0.6
    top = readers.read_text_columns(spark, str(tmp_path / "out" / "ranked_top_10pct"))
    assert top.count() == 60 and sorted(int(r["rank"]) for r in top.collect()) == list(range(1, 61))
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["run_id"] == told["run_id"]
    assert run_id(datetime(2024, 1, 2, 3, 4, 5)) == "run_20240102_030405"


def test_calibration(spark):
    df = rows_for_models(spark).select("encounter_id", "label", F.coalesce(1 / (1 + F.exp(-3 * F.col("x"))), F.lit(0.5)).alias("p_raw"))
    for over, c in (("logit", 1e6), ("prob", 1.0)):
        platt = models.Platt.fit(df, over=over, c=c)
        assert platt.slope > 0
    iso = models.isotonic(df)(df.withColumn("p_hat", platt.apply(F.col("p_raw"))))
    assert models.best_calibration(iso, ["p_raw", "p_iso"]) == "p_iso"
    pairs = sorted((r.p_raw, r.p_iso) for r in iso.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:], strict=False))


def test_deciles_merge_equal_edges(spark):
    df = spark.createDataFrame([(k, 0.5 if k < 80 else k / 100) for k in range(100)], "id bigint, p_hat double")
    out = ranked(df, "id").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 101))
    assert {r.risk_decile for r in out if r.p_hat == 0.5} == {1} and max(r.risk_decile for r in out) == 3


def test_tables_views_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, -4)], "k int, v int")
    one = writers.replace_in_place(df, str(tmp_path), "kept_rows")
    two = writers.replace_in_place(one.filter("v > 0"), str(tmp_path), "kept_rows")
    assert two.count() == 1 and spark.table("kept_rows").count() == 1 and one.count() == 2
    assert "kept_rows" in readers.table_names(spark)
    assert readers.table_info(df)[0][:2] == ("k", "int")
    assert readers.scalar(spark.sql("SELECT max(k) FROM kept_rows WHERE k < :top", args={"top": 9})) == 1
    assert spark.sql("SELECT sum(v) AS s FROM {rows}", rows=df).first().s == -2
    writers.write_report(tmp_path / "r.md", "Report", {"Rows": writers.records(df), "Note": "text"})
    assert "| k | v |" in (tmp_path / "r.md").read_text()
    (tmp_path / "b").mkdir()
    assert readers.first_existing([tmp_path / "a", tmp_path / "b"]) == tmp_path / "b"
    assert readers.find_root(tmp_path / "b", ["r.md"]) == tmp_path.resolve()
    with pytest.raises(FileNotFoundError):
        readers.first_existing([tmp_path / "a"])


def test_typed_reading_keeps_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text("encounter_id,kind,x\n5,None,1\n6,007,\n")
    df = readers.read_typed(spark, str(tmp_path / "in.csv"), CONTRACT.schema())
    assert [tuple(r) for r in df.collect()] == [(5, "None", 1.0), (6, "007", None)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(k, datetime(2024, 1, 1, k % 3), k % 2, k / 10) for k in range(10)], "id bigint, ts timestamp, label int, p double").repartition(2).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = score_stream(stream, lambda b: b.withColumn("p_hat", F.col("p") / 2), str(tmp_path / "out"), str(tmp_path / "audit"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert spark.read.parquet(str(tmp_path / "audit")).agg(F.sum("rows")).first()[0] == 10
    q = event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("rates").collect()) == 10


def test_contract_export_gives_an_input_that_passes(spark, tmp_path):
    df = rows_for_models(spark, 40)
    CONTRACT.export(df, tmp_path / "out", 3)
    held = Contract.load(tmp_path / "out" / "contract.json")
    example = readers.read_text_columns(spark, str(tmp_path / "out" / "input_example"))
    assert held == CONTRACT and sorted(r["encounter_id"] for r in example.collect()) == ["0", "1", "2"]
    assert validate(example, held, "score").rows.count() == 3
    with pytest.raises(ValueError, match="missing"):
        CONTRACT.export(df.drop("x"), tmp_path / "no")


def test_stored_table_replaced_from_itself(spark):
    name = "stored_rows"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writers.replace_stored(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), name)
    kept = writers.replace_stored(spark.table(name).filter("v is not null"), name)
    assert sorted(r.k for r in kept.collect()) == [1, 3] and sorted(r.k for r in spark.table(name).collect()) == [1, 3]
    assert [t for t in readers.table_names(spark) if t.startswith(name)] == [name]
    spark.sql(f"DROP TABLE {name}")


def test_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(30, "x,y"), (10, None), (20, 'say "so"')], "k int, v string").repartition(3)
    for single in (False, True):
        writers.write_csv(df, str(tmp_path / "plain"), single)
        back = readers.read_text_columns(spark, str(tmp_path / "plain"))
        assert sorted((int(r.k), r.v or "") for r in back.collect()) == [(10, ""), (20, 'say "so"'), (30, "x,y")]
    writers.write_csv(df, str(tmp_path / "indexed"), index_by="k")
    back = readers.read_text_columns(spark, str(tmp_path / "indexed"))
    assert back.columns == ["index", "k", "v"] and sorted((r["index"], r.k) for r in back.collect()) == [("0", "10"), ("1", "20"), ("2", "30")]


def test_prior_counts_of_missing_entities_and_dates(spark):
    from outrider.operators.history import with_prior_count

    rows = [(i, None if i % 3 == 0 else i % 2, None if i % 5 == 0 else f"2024-01-0{1 + i % 4}") for i in range(60)]
    got = with_prior_count(spark.createDataFrame(rows, "id int, who int, day string"), "who", "day", "id", "before").collect()
    key = lambda r: (r[2] is None, r[2] or "", r[0])
    assert {r.id: r.before for r in got} == {r[0]: sum(o[1] == r[1] and key(o) < key(r) for o in rows) for r in rows}
