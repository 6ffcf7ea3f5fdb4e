"""Sources: delimited text, tables, contracts and paths."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_columns(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', escape: str = '"', multiline: bool = False) -> DataFrame:
    """Delimited text with a header, every column a string; only an empty field is NULL."""
    return spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", escape).option("multiLine", multiline).csv(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, **options: Any) -> DataFrame:
    """Delimited text by an explicit schema, so that what training saw as text stays text. Columns are found by name."""
    raw = read_text_columns(spark, path, **options)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    return raw.select(*[typed.get(c, F.col(c)).alias(c) for c in raw.columns])


def with_ingest_time(df: DataFrame, name: str = "ingest_ts") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def bronze(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The raw file as text, and when it was read."""
    return with_ingest_time(read_text_columns(spark, path, **options))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(df: DataFrame, name: str) -> DataFrame:
    """``df``, also known to SQL by a name."""
    df.createOrReplaceTempView(name)
    return df


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_info(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def scalar(df: DataFrame) -> Any:
    """The first row's first value."""
    row = df.first()
    return row[0] if row else None


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def first_existing(paths: Iterable[str | Path]) -> Path:
    tried = [Path(p) for p in paths]
    for p in tried:
        if p.exists():
            return p
    raise FileNotFoundError(f"none of {[str(p) for p in tried]} exists")


def require_all(paths: Iterable[str | Path]) -> None:
    missing = [str(p) for p in paths if not Path(p).exists()]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")


def find_root(start: str | Path, markers: Sequence[str] = (".git",)) -> Path:
    """The nearest folder at or above ``start`` that has one of the markers."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if any((folder / m).exists() for m in markers):
            return folder
    raise FileNotFoundError(f"no folder at or above {here} has {list(markers)}")


@dataclass(frozen=True)
class Paths:
    """Where a scoring run finds its model and contract, and puts its results."""

    root: Path

    @property
    def model(self) -> Path:
        return self.root / "artifacts" / "model"

    @property
    def contract(self) -> Path:
        return self.root / "artifacts" / "contract.json"

    @property
    def calibration(self) -> Path:
        return self.root / "artifacts" / "calibration.json"

    @property
    def outputs(self) -> Path:
        return self.root / "outputs"
