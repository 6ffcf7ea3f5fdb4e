"""Packing of token pieces into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. All pieces then go, longest first,
into the tightest open window that has room, found by a segment tree over the remaining capacities.
Best-fit decreasing depends on the lengths alone, and there are no more lengths than the window has
tokens, so it runs over the counts of the lengths: a node of the tree holds runs of windows with
consecutive ids and the same room, and placing pieces moves whole runs. The plan is what placing all
pieces one by one would give, its size doesn't follow the input's, and each piece finds its window
by its rank among the pieces of its length.

Cases: a null text is empty and is one piece, the end token; equal pieces are ranked by their place
in the input; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outrider.llm.bpe import PATTERN, ByteBpe, encode_documents
from outrider.llm.common import written

END = 0
PLAN = "length int, low bigint, high bigint, sequence_from bigint, offset_from int, per_window int"


class Capacities:
    """A segment tree over remaining capacities 0..size; a leaf has runs (first id, number) of open windows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, room: int, first: int, number: int) -> None:
        if room and number:
            self.runs[room].append((first, number))
            self._count(room, number)

    def take(self, room: int, number: int) -> tuple[int, int]:
        """Up to ``number`` windows of one run."""
        first, n = self.runs[room].pop()
        if n > number:
            self.runs[room].append((first + number, n - number))
        self._count(room, -min(n, number))
        return first, min(n, number)

    def _count(self, room: int, by: int) -> None:
        k = room + self.width
        while k:
            self.open[k] += by
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open window has."""
        k = length + self.width
        while not self.open[k]:
            while k & 1:  # the right child, or the root: go up
                if k == 1 or k & (k + 1) == 0:
                    return None
                k //= 2
            k += 1
        while k < self.width:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.width


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple]:
    """Rows of PLAN from the number of pieces of each length.

    Of a length's pieces those with ranks in [low, high) go, ``per_window`` to each, into windows
    from ``sequence_from`` on, the first of each at ``offset_from``.
    """
    tree, plan, opened = Capacities(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            each = (room or window) // length  # a window stays the tightest until it has no room for another
            wanted = max(1, left // each)
            each = min(each, left)
            if room is None:
                room, first, number = window, opened, wanted
                opened += wanted
            else:
                first, number = tree.take(room, wanted)
            plan.append((length, rank, rank + number * each, first, window - room, each))
            tree.add(room - each * length, first, number)
            left -= number * each
            rank += number * each
    return plan


class Encoder:
    """The tokenizer's encoder in compiled code; its ids must be in the order of its merges."""

    def __init__(self, content: bytes):
        spec = ByteBpe(content)
        if (np.diff(spec.results) <= 0).any():
            raise ValueError("this vocabulary's ids are not in the order of its merges")
        special = set(spec.special.values())
        ranks = {t: i for i, t in enumerate(spec.token_bytes) if i not in special}
        self.inner = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=spec.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.inner.encode_to_numpy(t, allowed_special="all") for t in texts]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, payload: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids and an end token, cut into pieces of at most a window.

    ``payload`` is ``ids`` for the ids themselves or ``crc32`` for their checksum alone.
    """

    def row(_, doc, ids, __):
        every = np.append(ids, END).astype("<u4")
        cuts = range(0, len(every), window)
        parts = [every[k : k + window] for k in cuts]
        held = [p.astype(np.int32) if payload == "ids" else zlib.crc32(p.tobytes()) for p in parts]
        return [(doc, k, len(p), x, len(every)) for k, p, x in zip(cuts, parts, held, strict=True)]

    kind = {"ids": "ids array<int>", "crc32": "ids_crc32 bigint"}[payload]
    return encode_documents(docs, tokenizer, row, f"{id_col} bigint, start bigint, length bigint, {kind}, doc_tokens bigint", id_col, text_col, encoder)


def pack(pieces: DataFrame, window: int = 1024, subs: int | None = None) -> DataFrame:
    """``pieces`` (with a ``length`` of at most ``window``) and their sequence_id and offset.

    Ranks within a length are counted in sub-buckets, so that a frequent length is ranked by many tasks.
    """
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    subs = subs or min(4096, max(64, 1 << (pieces.count() // 1_000_000).bit_length()))
    pieces = pieces.withColumn("_sub", F.pmod(F.xxhash64("_row"), F.lit(subs)).cast("int")).withColumn("_length", F.col("length").cast("int"))
    counts = pieces.groupBy("_length", "_sub").agg(F.count("*").alias("_n"))
    before = counts.select("_length", "_sub", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_sub")) - F.col("_n")).alias("_before"))
    lengths = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}
    plan = pieces.sparkSession.createDataFrame(best_fit_decreasing(lengths, window), PLAN)
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_sub").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["_length", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    near = [ranked["_length"] == plan["length"], ranked["_rank"] >= plan["low"], ranked["_rank"] < plan["high"]]
    placed = ranked.join(F.broadcast(plan), near)  # its size depends on the window alone
    nth = ranked["_rank"] - plan["low"]
    own = [ranked[c] for c in pieces.columns if c not in ("_row", "_sub", "_length")]
    return placed.select(*own, (plan["sequence_from"] + F.floor(nth / plan["per_window"])).alias("sequence_id"), (plan["offset_from"] + nth % plan["per_window"] * plan["length"]).cast("bigint").alias("offset"))
