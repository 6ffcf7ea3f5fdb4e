"""Ranks, quantiles and running sums over a whole table, without a window in one partition.

Rows are dealt to cells of the score whose edges are its approximate quantiles, so that no cell has many
more rows than another whatever the distribution; a score that makes up several quantiles has a cell of its own,
which is dealt again by the tie-breaking key. The counts of the cells, a bounded number whatever the input, say how
many rows come before each; a window within the cell does the rest. The edges guide the dealing only: ranks
are exact wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS, SUBS = 2048, 64


def _known(c: str) -> Column:
    """The column as a number; NaN is missing, as NULL is."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def edges(values: Sequence[float] | None) -> list[float]:
    """Rising edges from quantiles; a value that fills several gets a cell of its own."""
    held = sorted(values or [])
    own = [math.nextafter(a, math.inf) for a, b in zip(held, held[1:], strict=False) if a == b]
    inner = sorted({v for v in [*held, *own] if math.isfinite(v)})
    return [-math.inf, *inner, math.inf] if inner else [-math.inf, 0.0, math.inf]


def _dealt(df: DataFrame, column: str, name: str, at: list[float]) -> DataFrame:
    """``df`` with the number of the cell between edges that ``column`` is in; NULL if it is."""
    cut = Bucketizer(splits=at, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return cut.withColumn(name, F.when(F.col(column).isNotNull(), F.col(name).cast("int")))


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """``df`` with each row's number, from 1, by score, then by the numeric column ``tie`` upwards; NULL and NaN scores come last."""
    shares = lambda n: [k / n for k in range(1, n)]
    plain = df.withColumn("_v", _known(score)).withColumn("_t", _known(tie))
    cells, subs = plain.agg(F.percentile_approx("_v", shares(CELLS), 4 * CELLS), F.percentile_approx("_t", shares(SUBS), 16 * SUBS)).first()
    dealt = _dealt(_dealt(plain, "_v", "_cell", edges(cells)), "_t", "_sub", edges(subs))
    last = 2 * CELLS + 2
    dealt = dealt.withColumn("_cell", F.coalesce(last - F.col("_cell") if descending else F.col("_cell"), F.lit(last + 1))).withColumn("_sub", F.coalesce("_sub", F.lit(2 * SUBS + 2)))
    # a sub-cell orders rows only among equal scores, so cells with several scores keep one
    score_now = F.when(F.col("_v").isNotNull(), F.col(score))
    several = dealt.groupBy("_cell").agg((F.min(score_now) != F.max(score_now)).alias("_several")).filter("_several").select("_cell", "_several")
    dealt = dealt.join(F.broadcast(several), "_cell", "left").withColumn("_sub", F.when(F.col("_several"), 0).otherwise(F.col("_sub"))).drop("_several")
    counts = dealt.groupBy("_cell", "_sub").agg(F.count("*").alias("_n"))
    before = counts.select("_cell", "_sub", (F.sum("_n").over(Window.orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    order = score_now.desc_nulls_last() if descending else score_now.asc_nulls_last()
    own = F.row_number().over(Window.partitionBy("_cell", "_sub").orderBy(order, F.col(tie).asc_nulls_last()))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(before), ["_cell", "_sub"])  # (2 * CELLS + 3) * (2 * SUBS + 3) rows at most
    return ranked.select(*df.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(name))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; NULL and NaN don't count."""
    return quantiles_of(df, [column], shares)[column]


def quantiles_of(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """The same for several columns at once, without moving a row.

    A pass counts the rows in bins between the bounds that hold a wanted rank, for all columns together; the
    bin with the rank, from its least to its greatest value, is cut into bins by the next pass, until it has one value only.
    The bounds' values are in different bins, so each pass narrows; for numbers without gaps of many magnitudes three or four do.
    """
    x = {c: _known(c) for c in columns}
    if not x:
        return {}
    finite = {c: F.when(F.abs(v) < math.inf, v) for c, v in x.items()}
    ends = df.agg(*[f for c in x for f in (F.count(x[c]), F.min(finite[c]), F.max(finite[c]))]).first()
    sizes = {c: ends[3 * i] for i, c in enumerate(x)}
    at = {c: [(n - 1) * s for s in shares] for c, n in sizes.items() if n}
    value: dict[str, dict[int, float]] = {c: {} for c in at}
    #: by column: (least, greatest, rows below, ranks wanted); the first holds all rows
    open_ = {c: [(ends[3 * i + 1] or 0.0, ends[3 * i + 2] or 0.0, 0, sorted({int(a) for a in at[c]} | {min(int(a) + 1, sizes[c] - 1) for a in at[c]}))] for i, c in enumerate(x) if c in at}
    whole = True
    while open_:
        bins = max(16, 4096 // sum(map(len, open_.values())))
        held = [F.struct(F.lit(c).alias("c"), _binned(x[c], parts, bins, whole).alias("k"), x[c].alias("v")) for c, parts in open_.items()]
        found = df.select(F.explode(F.array(*held)).alias("r")).select("r.*").filter("k is not null").groupBy("c", "k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counts: dict[tuple[str, int], list] = {}
        for r in sorted(found.collect(), key=lambda r: r["k"]):  # some 4,096 rows, or 18 for each bound
            counts.setdefault((r["c"], r["k"] // (bins + 2)), []).append(r)
        following: dict[str, list] = {}
        for c, parts in open_.items():
            for j, (_, _, below, ranks) in enumerate(parts):
                for r in counts[(c, j)]:
                    inside = [k for k in ranks if below <= k < below + r["n"]]
                    if inside and r["low"] == r["high"]:
                        value[c].update(dict.fromkeys(inside, r["low"]))
                    elif inside:
                        following.setdefault(c, []).append((r["low"], r["high"], below, inside))
                    below += r["n"]
        open_, whole = following, False
    between = lambda low, high, part: low if part == 0 or low == high else low + (high - low) * part
    return {c: [between(value[c][int(a)], value[c][min(int(a) + 1, sizes[c] - 1)], a - int(a)) for a in at[c]] if c in at else [None for _ in shares] for c in x}


def _binned(v: Column, parts: Sequence[tuple], bins: int, whole: bool) -> Column:
    """The number of the bounds that ``v`` is within, times ``bins + 2``, and of its bin there; infinite values, which only the first bounds hold, have bins of their own."""
    out = F.lit(None).cast("int")
    for j, (low, high, _, _) in enumerate(parts):
        half = 1.0 if math.isfinite(high - low) else 0.5
        place = F.floor((v * half - low * half) / (high * half - low * half) * bins).cast("int") if low < high else F.lit(0)
        inner = F.least(F.lit(bins - 1), place) + F.lit(j * (bins + 2) + 1)
        if whole:
            out = F.when(v == -math.inf, 0).when(v == math.inf, bins + 1).when(v.isNotNull(), inner)
        else:
            out = F.when((v >= low) & (v <= high), inner).otherwise(out)
    return out


def cumulative_by_score(df: DataFrame, label: str, score: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct score, from the highest: ``pos`` and ``n`` (weights with that score), ``tp`` and ``seen`` (with that or a higher one), and the totals ``all_pos`` and ``all_n``. NULL and NaN scores are the last one, NULL."""
    w = F.col(weight) if weight else F.lit(1)
    per = df.groupBy(*keys, _known(score).alias("score")).agg(F.sum(w * F.col(label)).cast("double").alias("pos"), F.sum(w).cast("double").alias("n"))
    at = edges(df.agg(F.percentile_approx(_known(score), [k / CELLS for k in range(1, CELLS)], 4 * CELLS)).first()[0])
    last = 2 * CELLS + 2
    per = _dealt(per, "score", "_up", at).withColumn("_cell", F.coalesce(last - F.col("_up"), F.lit(last + 1))).drop("_up")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    down = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = per.groupBy(*keys, "_cell").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    cells = cells.select(*keys, "_cell", (F.sum("_p").over(down) - F.col("_p")).alias("_tp"), (F.sum("_n").over(down) - F.col("_n")).alias("_seen"), F.sum("_p").over(whole).alias("all_pos"), F.sum("_n").over(whole).alias("all_n"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.desc_nulls_last("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(cells, [*keys, "_cell"])
    return out.select(*keys, "score", "pos", "n", (F.sum("pos").over(inside) + F.col("_tp")).alias("tp"), (F.sum("n").over(inside) + F.col("_seen")).alias("seen"), "all_pos", "all_n")
