"""Preprocessing, estimators, calibration and model comparison on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.contract import Contract
from outrider.functions.scalars import logit, sigmoid
from outrider.operators.metrics import evaluate, top_fractions
from outrider.operators.ordering import quantiles_of
from outrider.operators.profile import modes_of, scales_of


@dataclass
class Preparation:
    """Statistics of the training rows: medians, most frequent values, means and deviations."""

    numeric: dict[str, float]
    categorical: dict[str, str]
    means: dict[str, float]
    deviations: dict[str, float]
    indicators: bool = False
    centred: bool = True

    @classmethod
    def fit(cls, df: DataFrame, contract: Contract, indicators: bool = False, centred: bool = True) -> Preparation:
        numbers = [c for c in contract.feature_cols if c not in contract.categorical_cols]
        medians = {c: v[0] or 0.0 for c, v in quantiles_of(df, numbers, [0.5]).items()}
        modes = {c: v if v is not None else "missing" for c, v in modes_of(df, contract.categorical_cols).items()}
        filled = df.fillna(medians, subset=numbers) if numbers else df
        scales = scales_of(filled, numbers)
        return cls(medians, modes, {c: (mean or 0.0) for c, (mean, _) in scales.items()}, {c: (std or 1.0) for c, (_, std) in scales.items()}, indicators, centred)

    def apply(self, df: DataFrame) -> DataFrame:
        """Imputed and scaled columns beside the original ones: ``_x_`` numbers, ``_c_`` categories, ``_m_`` whether one was missing."""
        new: dict[str, Column] = {}
        for c, median in self.numeric.items():
            value = F.coalesce(F.col(c).cast("double"), F.lit(float(median)))
            new[f"_x_{c}"] = (value - F.lit(float(self.means[c] if self.centred else 0.0))) / F.lit(float(self.deviations[c] or 1.0))
        for c, mode in self.categorical.items():
            new[f"_c_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(mode))
        if self.indicators:
            new |= {f"_m_{c}": F.col(c).isNull().cast("double") for c in [*self.numeric, *self.categorical]}
        return df.withColumns(new)

    def stages(self) -> list[Estimator | VectorAssembler]:
        """Categories as one-hot vectors (an unseen one as zeros), assembled with the numbers."""
        c = [f"_c_{x}" for x in self.categorical]
        coded: list = []
        if c:
            coded = [StringIndexer(inputCols=c, outputCols=[f"{x}_i" for x in c], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{x}_i" for x in c], outputCols=[f"{x}_v" for x in c], dropLast=True)]
        inputs = [f"_x_{x}" for x in self.numeric] + [f"{x}_v" for x in c] + ([f"_m_{x}" for x in [*self.numeric, *self.categorical]] if self.indicators else [])
        return [*coded, VectorAssembler(inputCols=inputs, outputCol="_features")]


def logistic(n: int, c: float = 1.0, weight: str | None = None, label: str = "label") -> LogisticRegression:
    """L2-penalised logistic regression with inverse strength ``c`` over ``n`` rows."""
    made = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-6)
    return made.setWeightCol(weight) if weight else made


def tree(label: str = "label", depth: int = 6, leaf: int = 200, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="_features", labelCol=label, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def forest(label: str = "label", trees: int = 400, depth: int = 30, leaf: int = 50, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def boosting(label: str = "label", rounds: int = 400, depth: int = 6, rate: float = 0.05, leaf: int = 20, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, seed=seed)


def balanced_weights(df: DataFrame, label: str = "label", name: str = "_weight") -> DataFrame:
    """Weights n / (2 * n_c), so that both classes weigh the same."""
    n, pos = df.agg(F.count("*"), F.sum(label)).first()
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(n / (2 * max(pos or 0, 1)))).otherwise(F.lit(n / (2 * max(n - (pos or 0), 1)))))


def _released(fitted: PipelineModel) -> PipelineModel:
    """``fitted`` without training summaries. They go to the tasks with the model and hold the session, which can't be sent once it has observed rows or has tags."""
    for stage in fitted.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return fitted


@dataclass
class Model:
    """A preparation and a fitted pipeline, which keeps no training summary."""

    preparation: Preparation
    pipeline: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, contract: Contract, estimator: Estimator, indicators: bool = False, centred: bool = True) -> Model:
        prep = Preparation.fit(df, contract, indicators, centred)
        return cls(prep, _released(Pipeline(stages=[*prep.stages(), estimator]).fit(prep.apply(df))))

    def score(self, df: DataFrame, name: str = "p_raw") -> DataFrame:
        """``df`` with the probability of the label."""
        out = self.pipeline.transform(self.preparation.apply(df))
        return out.select(*df.columns, vector_to_array("probability")[1].alias(name))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        SparkSession.active().createDataFrame([(json.dumps(asdict(self.preparation)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/preparation")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        held = json.loads(spark.read.text(f"{path}/preparation").first()[0])
        return cls(Preparation(**held), PipelineModel.load(f"{path}/pipeline"))


@dataclass
class Platt:
    """A logistic curve over the logit of a score, or over the score itself."""

    slope: float
    intercept: float
    over: str = "logit"

    @classmethod
    def fit(cls, df: DataFrame, p: str = "p_raw", label: str = "label", over: str = "logit", c: float = 1e6) -> Platt:
        z = logit(F.col(p)) if over == "logit" else F.col(p)
        rows = VectorAssembler(inputCols=["_z"], outputCol="_features").transform(df.select(label, z.alias("_z")))
        fitted = logistic(max(rows.count(), 1), c, label=label).fit(rows)
        return cls(float(fitted.coefficients[0]), float(fitted.intercept), over)

    def apply(self, p: Column) -> Column:
        z = logit(p) if self.over == "logit" else p
        return sigmoid(F.lit(self.slope) * z + F.lit(self.intercept))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self)), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Platt:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))


def isotonic(df: DataFrame, p: str = "p_raw", label: str = "label", name: str = "p_iso") -> Callable[[DataFrame], DataFrame]:
    """A rising step curve from scores to rates, constant outside the scores it was fitted on."""
    fitted = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol=name).fit(df.select(F.col(p).cast("double"), F.col(label).cast("double")))
    return lambda rows: fitted.transform(rows)


def out_of_fold(df: DataFrame, contract: Contract, make: Callable[[DataFrame], Estimator], k: int = 5, fold: str = "fold", name: str = "p_raw") -> DataFrame:
    """Every row scored by a model that hasn't seen its fold."""
    parts = [Model.fit(seen := df.filter(F.col(fold) != f), contract, make(seen)).score(df.filter(F.col(fold) == f), name) for f in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_fitted(df: DataFrame, contract: Contract, make: Callable[[DataFrame], Estimator], k: int = 5, over: str = "logit") -> tuple[Model, Platt]:
    """A model of all rows, and a calibration of the scores that rows got out of fold."""
    return Model.fit(df, contract, make(df)), Platt.fit(out_of_fold(df, contract, make, k), over=over)


def leaderboard(train: DataFrame, valid: DataFrame, test: DataFrame, contract: Contract, candidates: dict[str, Callable[[DataFrame], Estimator]], id_col: str, by: str = "brier") -> tuple[DataFrame, dict[str, Model]]:
    """A row for each candidate: its metrics on valid and test; sorted by valid Brier, then average precision, or by that alone."""
    rows, models = [], {}
    for name, make in candidates.items():
        models[name] = Model.fit(train, contract, make(train))
        line: list = [name]
        for part in (valid, test):
            scored = models[name].score(part).select(id_col, "label", F.col("p_raw").alias("p")).cache()
            m = evaluate(scored).first()
            line += [m["pr_auc"], m["brier"], top_fractions(scored, id_col, fractions=[0.10]).first()["precision_at_k"]]
            scored.unpersist()
        rows.append(tuple(line))
    fields = "model string, valid_pr_auc double, valid_brier double, valid_top10_precision double, test_pr_auc double, test_brier double, test_top10_precision double"
    board = train.sparkSession.createDataFrame(rows, fields)
    order: Sequence[Column] = [F.asc("valid_brier"), F.desc("valid_pr_auc")] if by == "brier" else [F.desc("valid_pr_auc")]
    return board.orderBy(*order, "model"), models


def best_calibration(valid: DataFrame, candidates: Sequence[str], label: str = "label") -> str:
    """The score column with the lowest Brier score; the first of equally good ones."""
    means = valid.agg(*[F.avg((F.col(c) - F.col(label)) * (F.col(c) - F.col(label))).alias(c) for c in candidates]).first()
    return min(candidates, key=lambda c: means[c])
