"""Sinks: tables, views, audit rows, files and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.operators.ordering import global_rank


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a managed table in place of any before."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def replace_in_place(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df``, which may read the table it replaces: a new version is written, then the view of that name moves to it."""
    path = f"{folder.rstrip('/')}/{name}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def replace_stored(df: DataFrame, name: str) -> DataFrame:
    """A stored table replaced by ``df``, which may read it: the new one is written beside it before it goes and takes its name."""
    spark, beside = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.saveAsTable(beside)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
    return spark.table(name)


def replace_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def create_if_missing(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def append_row(spark: SparkSession, name: str, schema: str, row: Sequence[Any]) -> None:
    """One row at the end of a table with a fixed schema."""
    create_if_missing(spark, name, schema)
    spark.createDataFrame([tuple(row)], schema).write.mode("append").insertInto(name)


def write_csv(df: DataFrame, path: str, single: bool = False, index_by: str | None = None) -> None:
    """Text with a header, quotes doubled. ``single`` gathers everything in one file, for results known to be small; ``index_by`` puts the rows' number by that numeric column, from 0, first."""
    if index_by:
        df = global_rank(df, index_by, index_by, "_i", descending=False).select((F.col("_i") - 1).alias("index"), *df.columns)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(obj: Any, path: str | Path) -> None:
    Path(path).write_text(json.dumps(obj, indent=2), encoding="utf-8")


def records(df: DataFrame) -> list[dict]:
    """A small result as dictionaries."""
    return [r.asDict() for r in df.collect()]


def write_report(path: str | Path, title: str, sections: Mapping[str, str | Sequence[Mapping[str, Any]]]) -> None:
    """A Markdown report: text, or records as a table, under headings."""
    out = [f"# {title}", ""]
    for heading, body in sections.items():
        out += [f"## {heading}", ""]
        if isinstance(body, str):
            out.append(body)
        elif body:
            names = list(body[0])
            out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
            out += ["| " + " | ".join(f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |" for r in body]
        out.append("")
    Path(path).write_text("\n".join(out), encoding="utf-8")


def write_log(path: str | Path, lines: Sequence[str]) -> None:
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
