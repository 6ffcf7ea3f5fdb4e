"""The cluster bootstrap's metrics without a copy of any row.

An entity carries the list of the draws that picked it, so a row meets its entity's list once, however many
draws there are. Sums need the entity's sums only. Metrics that follow the order of scores take rows by
(entity, score) to cells of the score, as vectors with a place for each draw; a first pass adds up the cells, a second one
walks down each cell from what lies above it, a bounded piece at a time.

Cases: rows without an entity are in no draw; NULL and NaN scores are one step below all others; a NULL label
counts as a row without the label; metrics are NULL in draws where a class is missing; an empty table has no draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.functions.scalars import unit_interval
from outrider.operators.ordering import CELLS, _dealt, _known, edges, global_rank

#: Rows whose vectors are in memory at a time.
PIECE = 512
VECTORS = "cell int, score double, n binary, pos binary"
LAST = 2 * CELLS + 2


def picked(df: DataFrame, entity: str, draws: int, seed: int = 42) -> DataFrame:
    """(entity, picks): the draws that picked an entity, one as often as it did so. Each draw picks as many as there are, with replacement."""
    groups = global_rank(df.select(entity).distinct().filter(F.col(entity).isNotNull()), entity, entity, "_rank", descending=False)
    g = groups.count()
    picks = df.sparkSession.range(draws * g).select((F.col("id") / F.lit(g)).cast("bigint").cast("int").alias("draw"), (F.floor(unit_interval(F.col("id"), f"{seed}:") * g) + 1).alias("_rank"))
    lists = picks.groupBy("_rank").agg(F.collect_list("draw").alias("picks"))  # about ``draws`` numbers each
    return lists.join(groups, "_rank").select(entity, "picks")


def drawn_sums(df: DataFrame, entity: str, sums: dict[str, Column], picks: DataFrame) -> DataFrame:
    """Sums over the rows of each draw, from one row for each entity."""
    per = df.groupBy(entity).agg(*[c.alias(name) for name, c in sums.items()]).join(picks, entity)
    return per.select(F.explode("picks").alias("draw"), *sums).groupBy(F.col("draw").cast("bigint").alias("draw")).agg(*[F.sum(name).alias(name) for name in sums])


def steps(df: DataFrame, entity: str, label: str, p: str, picks: DataFrame) -> DataFrame:
    """(cell, score, n, pos, picks): the rows of an entity with a score, in cells that number from the highest score down."""
    known = df.select(entity, _known(p).alias("score"), F.coalesce(F.col(label), F.lit(0)).cast("bigint").alias("_l"))
    per = known.groupBy(entity, "score").agg(F.count("*").alias("n"), F.sum("_l").alias("pos"))
    at = edges(known.agg(F.percentile_approx("score", [k / CELLS for k in range(1, CELLS)], 4 * CELLS)).first()[0])
    cells = _dealt(per, "score", "_cell", at).withColumn("cell", F.coalesce(LAST - F.col("_cell"), F.lit(LAST + 1)))
    return cells.join(picks, entity).select("cell", "score", "n", "pos", "picks")


def ranked_draws(df: DataFrame, entity: str, label: str, p: str, draws: int, picks: DataFrame, fractions: Sequence[float] = ()) -> DataFrame:
    """For each draw ``pr_auc``, ``roc_auc`` and, for each fraction, positives captured and precision; of rows with the score at the edge a share counts."""
    dealt = steps(df, entity, label, p, picks).mapInArrow(lambda b: _vectors(b, draws), VECTORS).repartition("cell")
    above, n, pos = _above(dealt.mapInArrow(lambda b: _cell_sums(b, draws), VECTORS).collect(), draws)  # a row for each cell
    held = df.sparkSession.sparkContext.broadcast((above, n, pos))  # cells times draws, whatever the rows
    names = [f"h{i}" for i in range(len(fractions))]
    made = dealt.sortWithinPartitions("cell", F.col("score").desc_nulls_last()).mapInArrow(lambda b: _walked(b, draws, held.value, fractions), "draw bigint, " + ", ".join(f"{c} double" for c in ("a", "u", *names)))
    totals = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(n, pos, strict=True)) if a], "draw bigint, all_n double, all_pos double")  # a row for each draw
    out = made.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("a", "u", *names)]).join(totals, "draw")
    top = []
    for name, f in zip(names, fractions, strict=True):
        k = F.greatest(F.lit(1), F.floor(F.lit(float(f)) * F.col("all_n")))
        top += [F.col(name).alias(f"captured_top_{f * 100:g}"), (F.col(name) / k).alias(f"prec_top_{f * 100:g}")]
    return out.select("draw", F.expr("try_divide(a, all_pos)").alias("pr_auc"), F.expr("try_divide(u, all_pos * (all_n - all_pos))").alias("roc_auc"), *top)


def _batch(cell: np.ndarray, score: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("cell", pa.int32()), ("score", pa.float64()), ("n", pa.binary()), ("pos", pa.binary())])
    whole = lambda m: pa.array([row.astype(np.int64).tobytes() for row in m], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(score, pa.float64(), mask=np.isnan(score)), whole(n), whole(pos)], schema=schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _starts(cell: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Where a new cell or score begins; missing scores are NaN and equal each other."""
    same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
    return np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | ~same))


def _vectors(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[pa.RecordBatch]:
    """The picks as counts by draw, times the rows; rows of a piece with equal scores are added up."""
    for whole in batches:
        for low in range(0, whole.num_rows, PIECE):
            batch = whole.slice(low, PIECE)
            cell, score = _column(batch, "cell"), _column(batch, "score").astype(np.float64)
            picks = batch.column(batch.schema.get_field_index("picks"))
            times = np.diff(picks.offsets.to_numpy(zero_copy_only=False))
            at = np.repeat(np.arange(len(cell)), times) * draws + picks.flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(at, minlength=len(cell) * draws).reshape(len(cell), draws)
            order = np.lexsort((score, cell))
            cell, score, counts = cell[order], score[order], counts[order]
            first = _starts(cell, score)
            rows = [np.add.reduceat(counts * _column(batch, c).astype(np.int64)[order][:, None], first, axis=0) for c in ("n", "pos")]
            yield _batch(cell[first], score[first], *rows)


def _pieces(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for low in range(0, whole.num_rows, PIECE):
            batch = whole.slice(low, PIECE)
            matrix = lambda c, b=batch: np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.int64).reshape(-1, draws)
            yield _column(batch, "cell"), _column(batch, "score").astype(np.float64), matrix("n"), matrix("pos")


def _cell_sums(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[pa.RecordBatch]:
    """One row for each cell of the partition: its sums by draw."""
    held: dict[int, np.ndarray] = {}
    for cell, _, n, pos in _pieces(batches, draws):
        for c in np.unique(cell).tolist():
            own = np.stack([n[cell == c].sum(0), pos[cell == c].sum(0)])
            held[c] = held[c] + own if c in held else own
    if held:
        sums = np.stack(list(held.values()))
        yield _batch(np.array(list(held)), np.full(len(held), np.nan), sums[:, 0], sums[:, 1])


def _above(rows: list, draws: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each cell the rows and positives above it by draw, and those of all cells."""
    n, pos = np.zeros(draws, np.int64), np.zeros(draws, np.int64)
    above = {}
    for row in sorted(rows, key=lambda r: r["cell"]):
        above[row["cell"]] = (n, pos)
        n, pos = n + np.frombuffer(row["n"], np.int64), pos + np.frombuffer(row["pos"], np.int64)
    return above, n, pos


def _walked(batches: Iterator[pa.RecordBatch], draws: int, held: tuple, fractions: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """What the partition's scores add to each draw's metrics; a score at a piece's end waits for the next piece."""
    above, all_n, all_pos = held
    all_neg = all_n - all_pos
    edge = [np.maximum(1, np.floor(f * all_n)) for f in fractions]
    out = np.zeros((2 + len(fractions), draws))
    wait: tuple | None = None
    now, seen, tp = None, np.zeros(draws, np.int64), np.zeros(draws, np.int64)

    def walk(cell: int, n: np.ndarray, pos: np.ndarray) -> None:
        nonlocal now, seen, tp
        if cell != now:
            now, (seen, tp) = cell, above[cell]
        to, hit = seen + np.cumsum(n, 0), tp + np.cumsum(pos, 0)
        out[0] += (pos * hit / np.maximum(to, 1)).sum(0)
        out[1] += (pos * (all_neg - (to - hit) + (n - pos) / 2)).sum(0)
        for i, k in enumerate(edge):
            out[2 + i] += (pos * np.clip(k - (to - n), 0, n) / np.maximum(n, 1)).sum(0)
        seen, tp = to[-1], hit[-1]

    def cells(cell: np.ndarray, n: np.ndarray, pos: np.ndarray) -> None:
        cuts = [*np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            walk(int(cell[a]), n[a:b], pos[a:b])

    for piece in _pieces(batches, draws):
        if wait is not None:
            piece = tuple(np.concatenate(x) for x in zip(wait, piece, strict=True))
        cell, score, n, pos = piece
        first = _starts(cell, score)
        cell, score, n, pos = cell[first], score[first], np.add.reduceat(n, first, axis=0), np.add.reduceat(pos, first, axis=0)
        wait = (cell[-1:], score[-1:], n[-1:], pos[-1:])
        if len(cell) > 1:
            cells(cell[:-1], n[:-1], pos[:-1])
    if wait is not None:
        cells(wait[0], wait[2], wait[3])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int64()), *[pa.array(row, pa.float64()) for row in out]], names=["draw", "a", "u", *[f"h{i}" for i in range(len(fractions))]])
