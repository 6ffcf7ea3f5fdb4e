"""Feature contracts: which columns a model takes, and whether a table has them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outrider.functions.scalars import number_of
from outrider.operators.profile import missingness
from outrider.sources.readers import read_json
from outrider.sources.writers import write_csv, write_json

#: Columns that give the label away.
DENIED = ("readmitted", "y_readmit_30", "outcome", "target")
MOST_MISSING = 0.25


@dataclass
class Contract:
    id_cols: list[str]
    feature_cols: list[str]
    numeric_cols: list[str]
    categorical_cols: list[str]
    label_col: str | None = None
    treatment_col: str | None = None
    binary_cols: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        roles = [*self.numeric_cols, *self.categorical_cols, *self.binary_cols]
        if unknown := [c for c in roles if c not in self.feature_cols]:
            raise ValueError(f"roles for columns that are no features: {unknown}")
        for name in ("treatment_col", "label_col"):
            if getattr(self, name) and getattr(self, name) in self.feature_cols:
                raise ValueError(f"the {name} {getattr(self, name)} is among the features")

    @property
    def required_ids(self) -> list[str]:
        return [c for c in self.id_cols if c != "label"]

    def schema(self) -> T.StructType:
        """Features and ids as the model saw them: categories are text, whatever they look like."""
        kinds = dict.fromkeys(self.required_ids, T.LongType()) | dict.fromkeys(self.feature_cols, T.DoubleType()) | dict.fromkeys(self.categorical_cols, T.StringType())
        return T.StructType([T.StructField(c, k) for c, k in kinds.items()])

    def save(self, path: str | Path) -> None:
        write_json(asdict(self), path)

    @classmethod
    def load(cls, path: str | Path) -> Contract:
        held = read_json(path)
        return cls(**{k: v for k, v in held.items() if k in cls.__dataclass_fields__})

    def export(self, df: DataFrame, folder: str | Path, rows: int = 5) -> None:
        """``contract.json``, and ``input_example``, the ids and features of the ``rows`` smallest ids, as scoring takes them."""
        require_columns(df, [*self.required_ids, *self.feature_cols])
        Path(folder).mkdir(parents=True, exist_ok=True)
        self.save(Path(folder) / "contract.json")
        example = df.select(*self.required_ids, *self.feature_cols).orderBy(*self.required_ids).limit(rows)
        write_csv(example, str(Path(folder) / "input_example"), single=True)

    def select(self, df: DataFrame, *more: str) -> DataFrame:
        """Ids, label, treatment, ``more`` and the features, as far as the table has them."""
        names = [*self.required_ids, self.label_col, self.treatment_col, *more, *self.feature_cols]
        return df.select(*dict.fromkeys(c for c in names if c and c in df.columns))


def features_of(columns: Sequence[str], ids: Sequence[str]) -> list[str]:
    """All columns but the ids, in order."""
    return [c for c in columns if c not in set(ids)]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def fingerprint(df: DataFrame) -> str:
    """The MD5 of all names and types."""
    return hashlib.md5("|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema).encode()).hexdigest()


@dataclass
class Validated:
    features: DataFrame
    rows: DataFrame
    warnings: list[str]
    schema_hash: str
    has_label: bool


def _named(columns: Sequence[str], most: int) -> str:
    return f"{list(columns[:most])}{'...' if len(columns) > most else ''}"


def validate(df: DataFrame, contract: Contract, mode: str = "score", label: str = "label") -> Validated:
    """Checks a table against a contract before anything is written.

    Missing ids, features, or a label that is to be evaluated against are errors. Leaking and unknown columns
    are dropped with a warning; numbers that aren't become NULL.
    """
    if mode not in ("score", "evaluate"):
        raise ValueError("mode is score or evaluate")
    if missing := [c for c in contract.required_ids if c not in df.columns]:
        raise ValueError(f"missing id columns: {missing}")
    has_label = label in df.columns
    if mode == "evaluate" and not has_label:
        raise ValueError(f"evaluate needs the column {label}")
    warnings = []
    if leaking := sorted(c for c in df.columns if c in DENIED):
        warnings.append(f"columns that leak the label, dropped: {leaking}")
        df = df.drop(*leaking)
    if missing := [c for c in contract.feature_cols if c not in df.columns]:
        raise ValueError(f"missing features: {_named(missing, 20)}")
    keep = [*contract.required_ids, *contract.feature_cols, *([label] if has_label else [])]
    if extra := [c for c in df.columns if c not in keep]:
        warnings.append(f"unknown columns, ignored: {_named(extra, 20)}")
    numbers = {*contract.numeric_cols, *([label] if has_label else [])}
    rows = df.select(*[number_of(F.col(c)).alias(c) if c in numbers else F.col(c).cast("string").alias(c) if c in contract.categorical_cols else F.col(c) for c in keep])
    gone = missingness(rows, [*contract.feature_cols, *([label] if has_label else [])]).collect()
    if high := [r["column"] for r in sorted(gone, key=lambda r: -r["missing_rate"]) if r["column"] != label and r["missing_rate"] > MOST_MISSING]:
        warnings.append(f"features missing in more than a quarter of the rows: {_named(high, 15)}")
    if has_label and (bad := next(r["missing_count"] for r in gone if r["column"] == label)):
        warnings.append(f"{bad} labels are missing or not numeric")
    return Validated(rows.select(*contract.feature_cols), rows, warnings, fingerprint(rows), has_label)
