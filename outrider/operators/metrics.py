"""Evaluation of scores against binary labels, as aggregates, with optional weights and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.functions.bins import equal_width_bin, quantile_bin
from outrider.functions.scalars import probability
from outrider.operators.ordering import cumulative_by_score, global_rank, quantiles

TOP_FRACTIONS = (0.01, 0.05, 0.10, 0.20)
QUANTILES = {"q0": 0.0, "q1": 0.01, "q5": 0.05, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q100": 1.0}


def brier(label: str, p: str, w: Column | None = None) -> Column:
    return _mean((F.col(p) - F.col(label)) * (F.col(p) - F.col(label)), w)


def log_loss(label: str, p: str, w: Column | None = None, eps: float = 1e-15) -> Column:
    q = probability(F.col(p), eps)
    return -_mean(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q), w)


def _mean(value: Column, w: Column | None) -> Column:
    return F.avg(value) if w is None else F.sum(value * w) / F.sum(w)


def ranking_metrics(df: DataFrame, label: str, p: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``pr_auc`` (average precision, in steps) and ``roc_auc`` (ties count half); NULL where a class is missing."""
    cum = cumulative_by_score(df, label, p, weight, keys)
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    below = all_neg - (F.col("seen") - F.col("tp"))
    steps = cum.select(*keys, "all_pos", all_neg.alias("all_neg"), (F.col("pos") * F.col("tp") / F.col("seen")).alias("a"), (F.col("pos") * (below + neg / 2)).alias("u"))
    grouped = steps.groupBy(*keys)
    return grouped.agg(F.expr("try_divide(sum(a), max(all_pos))").alias("pr_auc"), F.expr("try_divide(sum(u), max(all_pos) * max(all_neg))").alias("roc_auc"))


def pointwise_metrics(df: DataFrame, label: str, p: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight) if weight else None
    rows = F.count("*") if w is None else F.sum(w)
    return df.groupBy(*keys).agg(rows.cast("bigint").alias("n"), _mean(F.col(label), w).alias("prevalence"), _mean(F.col(p), w).alias("mean_p"), brier(label, p, w).alias("brier"), log_loss(label, p, w).alias("logloss"))


def evaluate(df: DataFrame, label: str = "label", p: str = "p", weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics, a row for each key (one without keys)."""
    points, ranks = pointwise_metrics(df, label, p, weight, keys), ranking_metrics(df, label, p, weight, keys)
    return points.join(ranks, list(keys)) if keys else points.crossJoin(F.broadcast(ranks))  # one row each


def expected_calibration_error(df: DataFrame, label: str = "label", p: str = "p", bins: int = 10, closed_top: bool = True) -> DataFrame:
    """Mean distance of the bins' mean score from their rate, by share of rows. Without ``closed_top``, scores of 1 count in the rows but in no bin."""
    per = df.groupBy(equal_width_bin(F.col(p), bins, closed_top).alias("bin")).agg(F.count("*").alias("n"), F.avg(label).alias("acc"), F.avg(p).alias("conf"))
    inside = F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0)
    return per.agg((F.sum(inside) / F.sum("n")).alias("ece"))


def threshold_metrics(df: DataFrame, at: float | Column, label: str = "label", p: str = "p") -> DataFrame:
    """Precision and recall (0 where undefined) and the share flagged at a threshold."""
    hit = F.col(p) >= at
    tp, flagged = F.sum(F.when(hit, F.col(label)).otherwise(0)), F.sum(hit.cast("int"))
    return df.agg(tp.cast("bigint").alias("tp"), flagged.cast("bigint").alias("flagged"), F.sum(label).cast("bigint").alias("positives"), F.count("*").alias("n")).select(
        "tp", "flagged", F.expr("coalesce(try_divide(tp, flagged), 0.0D)").alias("precision"), F.expr("coalesce(try_divide(tp, positives), 0.0D)").alias("recall"), (F.col("flagged") / F.col("n")).alias("flagged_fraction")
    )


def top_fractions(df: DataFrame, id_col: str, label: str = "label", p: str = "p", fractions: Sequence[float] = TOP_FRACTIONS, threshold: str = "quantile") -> DataFrame:
    """For each fraction f the ``k = max(1, floor(f * n))`` highest scores: captured, precision_at_k and threshold.

    The threshold is the interpolated quantile 1 - f, or with ``kth`` the lowest score taken. Equal scores go by id.
    """
    n = df.count()
    ks = [max(1, int(f * n)) for f in fractions]
    ranked = global_rank(df.select(id_col, label, p), p, id_col).filter(F.col("rank") <= max(ks))
    sums = ranked.agg(*[F.sum(F.when(F.col("rank") <= k, F.col(label)).otherwise(0)).cast("bigint").alias(f"c{k}") for k in dict.fromkeys(ks)], *[F.min(F.when(F.col("rank") <= k, F.col(p))).alias(f"t{k}") for k in dict.fromkeys(ks)]).first()
    cut = quantiles(df, p, [1 - f for f in fractions]) if threshold == "quantile" else [sums[f"t{k}"] for k in ks]
    rows = [(float(f), k, int(sums[f"c{k}"] or 0), float(sums[f"c{k}"] or 0) / k, t) for f, k, t in zip(fractions, ks, cut, strict=True)]
    return df.sparkSession.createDataFrame(rows, "top_frac double, k bigint, captured bigint, precision_at_k double, threshold double")


def capacity_threshold(df: DataFrame, fraction: float, p: str = "p") -> float | None:
    """The score that about this fraction of rows reaches."""
    return quantiles(df, p, [1 - fraction])[0]


def distribution(df: DataFrame, p: str = "p") -> DataFrame:
    """Mean, median and nine quantiles of the scores."""
    q = quantiles(df, p, list(QUANTILES.values()))
    return df.agg(F.avg(p).alias("mean")).select("mean", F.lit(q[4]).alias("median"), *[F.lit(v).alias(k) for k, v in zip(QUANTILES, q, strict=True)])


def precision_recall_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Points by threshold, and the end (recall 0, precision 1) without one."""
    cum = cumulative_by_score(df, label, p)
    points = cum.select(F.col("score").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), F.expr("try_divide(tp, all_pos)").alias("recall"))
    return points.unionByName(df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def roc_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Points by threshold, all of them, and the start (0, 0) without one."""
    cum = cumulative_by_score(df, label, p)
    points = cum.select(F.col("score").alias("threshold"), F.expr("try_divide(seen - tp, all_n - all_pos)").alias("fpr"), F.expr("try_divide(tp, all_pos)").alias("tpr"))
    return points.unionByName(df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"))


def decile_edges(df: DataFrame, p: str = "p", bins: int = 10) -> list[float]:
    return quantiles(df, p, [k / bins for k in range(bins + 1)])


def with_risk_decile(df: DataFrame, p: str = "p", bins: int = 10, name: str = "risk_decile") -> DataFrame:
    """Quantile bins of the score, the highest number for the highest risk; equal edges are merged."""
    edges = decile_edges(df, p, bins)
    return df.withColumn(name, quantile_bin(F.col(p), edges) if edges[0] is not None else F.lit(None).cast("int"))


def reliability(df: DataFrame, label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean score, rate and rows of each quantile bin."""
    return with_risk_decile(df, p, bins).groupBy("risk_decile").agg(F.avg(p).alias("mean_p"), F.avg(label).alias("observed"), F.count("*").alias("n"))


def cumulative_gains(df: DataFrame, id_col: str, label: str = "label", p: str = "p") -> DataFrame:
    """For each row, from the highest score: its rank, the share of rows and the share of positives up to it."""
    n = df.count()
    ranked = global_rank(df.select(id_col, label, p), p, id_col)
    running = running_sum(ranked, "rank", label, n)
    total = F.sum(label).alias("t")
    return running.crossJoin(F.broadcast(df.agg(total))).select(id_col, "rank", (F.col("rank") / F.lit(n)).alias("population"), F.expr("coalesce(try_divide(running, t), 0.0D)").alias("gain"))  # a single row


def running_sum(ranked: DataFrame, rank: str, value: str, n: int, name: str = "running", blocks: int = 1024) -> DataFrame:
    """The sum of ``value`` over all rows of at most this rank: the sums of the blocks before, then within the block."""
    from pyspark.sql.window import Window

    size = max(1, -(-n // blocks))
    dealt = ranked.withColumn("_block", F.floor((F.col(rank) - 1) / size).cast("int"))
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_s"))
    before = sums.select("_block", (F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(before), "_block")  # ``blocks`` rows at most
    return out.select(*ranked.columns, (F.col("_in") + F.col("_before")).alias(name))
