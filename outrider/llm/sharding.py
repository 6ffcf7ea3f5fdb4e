"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of positions. Each shard takes several of them by hash (its virtual
nodes); a key goes to the first virtual node at or after its own position. No shard holds more than
its capacity: first every shard takes keys that are at home, in ring order, until it is full; what
doesn't fit goes on clockwise to the next virtual node whose shard has room. As the capacities add
up to the number of keys, with no slack the counts of any two shards differ by at most one; with
slack, fewer keys leave home.

Only counts decide, so nothing is walked key by key: the rows are counted by ring position and
sub-bucket (at most ``positions * SUBS`` counts, whatever the input), the walk along the ring deals
out ranges of ranks, and each row finds its shard and its place there by its own rank. The sub-bucket
depends on the rest of the row, so a key that holds many rows is still ranked by many tasks.

Cases: a null key is a key like any other and a null text has no bytes; rows that agree in
everything are told apart by rank alone, so any order of them gives the same result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outrider.llm.common import text_of

SUBS = 16
PLAN = "position int, sub int, low bigint, high bigint, home int, shard int, slot_from bigint"


def ring_positions(shards: int, nodes: int) -> int:
    """A power of two, at least four for each virtual node and 4096."""
    return max(4096, 1 << (4 * shards * nodes - 1).bit_length())


def ring(shards: int, nodes: int, positions: int) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes in ring order; a node whose position is taken goes to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            at = zlib.crc32(f"{shard}/{node}".encode()) % positions
            while at in taken:
                at = (at + 1) % positions
            taken[at] = shard
    return sorted(taken.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [total // shards + (k < total % shards) for k in range(shards)]
    return [-(-int(total * (1 + slack)) // shards) + 1] * shards


def deal(counts: list[tuple[int, int, int]], shards: int, nodes: int, slack: float = 0.0) -> list[tuple]:
    """Deals out counted rows: rows of PLAN from (position, sub, count).

    A plan row says that of a sub-bucket's rows those with ranks in [low, high) go to ``shard``,
    the first of them into slot ``slot_from``.
    """
    positions = ring_positions(shards, nodes)
    points = ring(shards, nodes, positions)
    free, filled, plan = capacities(sum(c for *_, c in counts), shards, slack), [0] * shards, []
    over: list[list[list[int]]] = [[] for _ in points]
    at = 0
    for position, sub, count in sorted(counts):
        while at < len(points) and points[at][0] < position:
            at += 1
        node = at % len(points)
        home = points[node][1]
        take = min(count, free[home])
        if take:
            plan.append((position, sub, 0, take, home, home, filled[home]))
            free[home] -= take
            filled[home] += take
        if take < count:
            over[node].append([position, sub, take, count, home])
    moving: list[list[int]] = []
    for step in range(2 * len(points)):
        node = step % len(points)
        shard = points[node][1]
        while moving and free[shard]:
            x = moving[0]
            take = min(x[3] - x[2], free[shard])
            plan.append((*x[:2], x[2], x[2] + take, x[4], shard, filled[shard]))
            free[shard] -= take
            filled[shard] += take
            x[2] += take
            if x[2] == x[3]:
                moving.pop(0)
        if step < len(points):
            moving += over[node]
    return plan


def shard_bounded(docs: DataFrame, key: Column, shards: int, nodes: int = 64, slack: float = 0.0, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, size, text_crc32, home, shard and slot (gapless from 0 in each shard) of each row."""
    positions = ring_positions(shards, nodes)
    text = text_of(text_col)
    rows = docs.select(
        *columns,
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(key).alias("_hash"),
    ).withColumns({
        "position": F.pmod(F.col("_hash"), F.lit(positions)).cast("int"),
        "sub": F.pmod(F.xxhash64("_hash", "text_crc32"), F.lit(SUBS)).cast("int"),
    })
    counts = [tuple(r) for r in rows.groupBy("position", "sub").count().collect()]
    plan = docs.sparkSession.createDataFrame(deal(counts, shards, nodes, slack), PLAN)
    cell = Window.partitionBy("position", "sub")
    ranked = rows.withColumn("_rank", F.row_number().over(cell.orderBy("_hash", "text_crc32", *columns)) - 1)
    near = [ranked["position"] == plan["position"], ranked["sub"] == plan["sub"], ranked["_rank"] >= plan["low"], ranked["_rank"] < plan["high"]]
    placed = ranked.join(F.broadcast(plan), near)  # at most a row for each ring position, sub-bucket and shard it spills to
    return placed.select(*columns, "size", "text_crc32", "home", "shard", (plan["slot_from"] + ranked["_rank"] - plan["low"]).alias("slot"))
