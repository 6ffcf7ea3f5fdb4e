"""Splits that keep an entity's rows together, folds, and the cluster bootstrap. All follow from hashes of the ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrider.functions.scalars import portable_hash, probability, unit_interval
from outrider.operators.bootstrap import drawn_sums, picked, ranked_draws
from outrider.operators.metrics import TOP_FRACTIONS
from outrider.operators.ordering import cumulative_by_score, global_rank


def hash_split(df: DataFrame, entity: str, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """``df`` with ``split``: train, valid or test by the entity's place in [0, 1)."""
    u = unit_interval(F.col(entity))
    return df.withColumn("split", F.when(u < train, "train").when(u < valid, "valid").otherwise("test"))


def group_split(df: DataFrame, entity: str, share: float = 0.2, seed: int = 42, names: tuple[str, str] = ("train", "test"), column: str = "split") -> DataFrame:
    """``share`` of the entities, rounded up, in the second part: those with the smallest hashes. Rows without an entity are in the first."""
    groups = df.filter(F.col(entity).isNotNull()).select(entity).distinct().withColumn("_h", portable_hash(F.col(entity), f"{seed}:"))
    ranked = global_rank(groups, "_h", entity, "_rank", descending=False)
    take = math.ceil(share * groups.count())
    parts = ranked.select(entity, F.when(F.col("_rank") <= take, names[1]).otherwise(names[0]).alias(column))
    return df.join(parts, entity, "left").fillna(names[0], [column])


def three_way_split(df: DataFrame, entity: str, seed: int = 42) -> DataFrame:
    """20 % of the entities for test, then 25 % of the others for valid."""
    first = group_split(df, entity, 0.2, seed, ("rest", "test"), "_first")
    rest = group_split(first.filter("_first = 'rest'"), entity, 0.25, seed + 1, ("train", "valid"))
    return rest.drop("_first").unionByName(first.filter("_first = 'test'").withColumn("split", F.lit("test")).drop("_first"))


def group_folds(df: DataFrame, entity: str, k: int = 5, name: str = "fold") -> DataFrame:
    return df.withColumn(name, (portable_hash(F.col(entity)) % k).cast("int"))


def split_quality(df: DataFrame, entity: str, label: str) -> DataFrame:
    """Rows, entities and the label's rate of each split."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("people"), F.avg(label).alias("prevalence"))


def straddling(df: DataFrame, entity: str) -> DataFrame:
    """The number of entities in more than one split."""
    return df.groupBy(entity).agg(F.count_distinct("split").alias("k")).filter("k > 1").agg(F.count("*").alias("straddling"))


def manifest(df: DataFrame, entity: str, label: str, seed: int = 42) -> dict:
    """What a split consists of, for ``write_json``: rows, people and the label's rate of each part, and entities in more than one."""
    parts = {r["split"]: {"rows": r["rows"], "people": r["people"], "prevalence": r["prevalence"]} for r in split_quality(df, entity, label).collect()}  # a row for each part
    return {"entity": entity, "label": label, "seed": seed, "parts": parts, "straddling": straddling(df, entity).first()["straddling"]}


def bootstrap_weights(df: DataFrame, entity: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, entity, weight): in each draw as many entities as there are, with replacement; the draw's number for each."""
    picks = picked(df, entity, draws, seed).select(entity, F.explode("picks").alias("draw"))
    return picks.groupBy(F.col("draw").cast("bigint").alias("draw"), entity).agg(F.count("*").alias("weight"))


def bootstrap_pointwise(df: DataFrame, entity: str, label: str = "label", p: str = "p", draws: int = 500, seed: int = 42) -> DataFrame:
    """Rows, rate, mean score, Brier score and log loss of each draw."""
    return _pointwise(df, entity, label, p, picked(df, entity, draws, seed))


def _pointwise(df: DataFrame, entity: str, label: str, p: str, picks: DataFrame) -> DataFrame:
    y, q, s = F.col(label), probability(F.col(p)), F.col(p)
    sums = {"n": F.count("*"), "prevalence": F.sum(y), "mean_p": F.sum(s), "brier": F.sum((s - y) * (s - y)), "logloss": -F.sum(y * F.log(q) + (1 - y) * F.log(1 - q))}
    drawn = drawn_sums(df, entity, sums, picks)
    return drawn.select("draw", "n", *[(F.col(c) / F.col("n")).alias(c) for c in list(sums)[1:]])


def cluster_bootstrap(df: DataFrame, entity: str, label: str = "label", p: str = "p", draws: int = 500, seed: int = 42, fractions: Sequence[float] = ()) -> DataFrame:
    """The metrics of each draw, with ``fractions`` also those of its top. An entity's rows are all taken, as often as it was drawn; none is copied."""
    picks = picked(df, entity, draws, seed)
    return _pointwise(df, entity, label, p, picks).join(ranked_draws(df, entity, label, p, draws, picks, fractions), "draw")


def bootstrap_top(df: DataFrame, entity: str, label: str = "label", p: str = "p", draws: int = 500, seed: int = 42, fractions: Sequence[float] = TOP_FRACTIONS) -> DataFrame:
    """Captured positives and precision in each draw's top fractions; of rows with the score at the edge a share counts."""
    return ranked_draws(df, entity, label, p, draws, picked(df, entity, draws, seed), fractions).drop("pr_auc", "roc_auc")


def weighted_top(rows: DataFrame, label: str = "label", p: str = "p", fractions: Sequence[float] = TOP_FRACTIONS) -> DataFrame:
    """The same for rows with a draw and a weight."""
    cum = cumulative_by_score(rows, label, p, "weight", ["draw"])
    aggs = []
    for f in fractions:
        k = F.greatest(F.lit(1), F.floor(F.lit(float(f)) * F.col("all_n")))
        took = F.greatest(F.lit(0), F.least(F.col("n"), k - (F.col("seen") - F.col("n"))))
        hits = F.sum(F.col("pos") * took / F.col("n"))
        aggs += [hits.alias(f"captured_top_{f * 100:g}"), (hits / F.max(k)).alias(f"prec_top_{f * 100:g}")]
    return cum.groupBy("draw").agg(*aggs)


def intervals(draws: DataFrame, points: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(metric, point_estimate, ci95_low, ci95_high) from draws, of which there are few, and one row of points."""
    q = draws.agg(*[F.percentile(c, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"p.{c}").cast("double").alias("point_estimate"), F.col(f"q.{c}")[0].alias("ci95_low"), F.col(f"q.{c}")[1].alias("ci95_high")) for c in columns])
    return q.alias("q").crossJoin(points.alias("p")).select(F.explode(each).alias("r")).select("r.*")
