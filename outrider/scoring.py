"""Batch scoring: validate, score, calibrate, rank, write.

    python -m outrider.scoring --root DIR --input FILE [--output DIR] [--mode score|evaluate] [--write-table]

``--root`` has ``artifacts/model``, ``artifacts/contract.json`` and ``artifacts/calibration.json``.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.contract import Contract, Validated, validate
from outrider.operators.metrics import TOP_FRACTIONS, distribution, evaluate, top_fractions, with_risk_decile
from outrider.operators.models import Model, Platt
from outrider.operators.ordering import global_rank
from outrider.session import build_session
from outrider.sources.readers import Paths, read_text_columns, require_all
from outrider.sources.writers import append_row, records, replace_table, write_csv, write_json, write_log

AUDIT = "run_id string, timestamp_local string, input_path string, mode string, rows_scored bigint, schema_hash string, warnings_json string"


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("run_%Y%m%d_%H%M%S")


def scored(rows: DataFrame, model: Model, platt: Platt) -> DataFrame:
    """``p_raw`` from the model and ``p_hat``, calibrated."""
    return model.score(rows, "p_raw").withColumn("p_hat", platt.apply(F.col("p_raw")))


def ranked(rows: DataFrame, id_col: str, p: str = "p_hat") -> DataFrame:
    """Rank 1 for the highest score, equal ones by id, and risk deciles, 10 the highest."""
    return with_risk_decile(global_rank(rows, p, id_col), p)


def summary(rows: DataFrame, held: Validated, run: str, mode: str, source: str, outputs: dict, id_col: str, fractions=TOP_FRACTIONS) -> dict[str, Any]:
    spread = records(distribution(rows, "p_hat"))[0]
    mean, median = spread.pop("mean"), spread.pop("median")
    out = {"run_id": run, "mode": mode, "input": source, "rows": rows.count(), "schema_hash": held.schema_hash, "warnings": held.warnings, "probability_distribution": {"mean": mean, "median": median, "quantiles": spread}, "outputs": outputs}
    if mode == "evaluate":
        labelled = rows.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("int"))
        out["metrics"] = records(evaluate(labelled, p="p_hat"))[0]
        out["topk_metrics"] = records(top_fractions(labelled, id_col, p="p_hat", fractions=fractions))
    return out


def score_file(spark: SparkSession, root: str | Path, source: str, output: str | Path | None = None, mode: str = "auto", write_table: bool = False, fractions=TOP_FRACTIONS) -> dict[str, Any]:
    """Scores a delimited file and writes ``scored``, ``ranked_top_*pct``, ``summary.json`` and ``run_log.txt``; nothing is written if validation fails.

    ``mode="auto"`` evaluates if the file has labels. With ``write_table`` the scored rows replace a table and the run is added to an audit table.
    """
    paths, run = Paths(Path(root)), run_id()
    require_all([paths.model, paths.contract, paths.calibration])
    contract = Contract.load(paths.contract)
    raw = read_text_columns(spark, source)
    if mode == "auto":
        mode = "evaluate" if "label" in raw.columns else "score"
    held = validate(raw, contract, mode)
    key = contract.required_ids[0]
    rows = held.rows.withColumns({c: F.col(c).try_cast("bigint") for c in contract.required_ids})
    given = scored(rows, Model.load(spark, str(paths.model)), Platt.load(paths.calibration)).cache()
    done = ranked(given, key).cache()
    target = Path(output or paths.outputs)
    target.mkdir(parents=True, exist_ok=True)
    n = done.count()
    write_csv(done.orderBy("rank"), str(target / "scored"))
    tops = {}
    for f in fractions:
        name = str(target / f"ranked_top_{int(f * 100)}pct")
        write_csv(done.filter(F.col("rank") <= max(1, int(f * n))).orderBy("rank"), name)
        tops[str(f)] = name
    told = summary(done, held, run, mode, source, {"scored_csv": str(target / "scored"), "topk_files": list(tops.values())}, key, fractions)
    write_json(told, target / "summary.json")
    write_log(target / "run_log.txt", [f"run {run}", f"at {datetime.now(timezone.utc).isoformat(timespec='seconds')}", f"input {source}", f"mode {mode}", f"rows {n}", f"schema {held.schema_hash}", *[f"warning: {w}" for w in held.warnings], *[f"wrote {p}" for p in tops.values()]])
    if write_table:
        replace_table(done, "scored_latest")
        append_row(spark, "scored_runs", AUDIT, (run, datetime.now(timezone.utc).isoformat(timespec="seconds"), source, mode, n, held.schema_hash, json.dumps(held.warnings)))
    done.unpersist()
    given.unpersist()
    return told


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Score a delimited file.")
    parser.add_argument("--root", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output")
    parser.add_argument("--mode", choices=("auto", "score", "evaluate"), default="auto")
    parser.add_argument("--write-table", action="store_true")
    a = parser.parse_args(argv)
    told = score_file(build_session("outrider-scoring"), a.root, a.input, a.output, a.mode, a.write_table)
    print(json.dumps({k: told[k] for k in ("run_id", "mode", "rows", "warnings")}))


if __name__ == "__main__":
    main()
