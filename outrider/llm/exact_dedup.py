"""Exact duplicates by a minimal perfect hash over the digests of what was taken in before.

The history's distinct digests are dealt to buckets of bounded size. Each bucket gets its own
minimal perfect hash: levels of bit arrays in which a digest that is alone in its position takes
it, all others going on to the next level. The rank of a digest's bit is its slot; the slot holds
the full digest and the locator of the row that stays. New rows look themselves up, and since the
hash gives a slot to any digest, the slot's digest is compared byte by byte. Rows that aren't in the
history are grouped among themselves.

Cases: a null text counts as empty; a null id is smaller than any other; of rows that agree in text
and id exactly one stays; an empty table gives an empty result; columns of the input other than the id
and the text are never read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.llm.common import ascii_lower, one_of_each, text_of, written

DIGEST = 32
#: Digests in a bucket, on average; bounds the memory of a task.
BUCKET = 20_000
INDEX = "bucket int, levels array<int>, bits binary, digests binary, ids array<bigint>, rows array<bigint>, counts array<bigint>"
INDEX_NAMES = ["bucket", "levels", "bits", "digests", "ids", "rows", "counts"]
WINNERS = "digest binary, keep_id bigint, keep_row bigint, group_size bigint, historical boolean"
WINNER_NAMES = ["digest", "keep_id", "keep_row", "group_size", "historical"]


def _mixed(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The positions of digests (rows of four 64-bit words) in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_mph(words: np.ndarray, spread: float = 1.5) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, all levels' bits, and the slot of each of the distinct digests."""
    left, sizes, bits = np.arange(len(words)), [], []
    where = np.zeros(len(words), np.int64)
    start = 0
    while len(left):
        size = max(8, int(len(left) * spread))
        at = _mixed(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        where[left[placed]] = start + at[placed]
        sizes.append(size)
        bits.append(alone)
        start += size
        left = left[~placed]
    every = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, every, (np.cumsum(every) - 1)[where] if len(words) else where


def lookup_mph(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The only slot that each digest could have; -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    slot, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = start + _mixed(words[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return slot


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, DIGEST // 8) if digests else np.zeros((0, DIGEST // 8), np.uint64)


def _binary(words: np.ndarray) -> pa.Array:
    offsets = np.arange(len(words) + 1, dtype=np.int32) * DIGEST
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes())])


def _locators(ids: pa.Array, rows: pa.Array, counts: pa.Array) -> list[np.ndarray]:
    """Whether there is an id, the id (0 for none), the row and the number of rows."""
    return [np.array(ids.is_valid()), np.array(ids.fill_null(0)), np.array(rows), np.array(counts)]


def _index(groups: pa.Table) -> pa.Table:
    groups = groups.combine_chunks()
    words = _words(b"".join(groups["digest"].to_pylist()))
    sizes, bits, slot = build_mph(words)
    order = pa.array(np.argsort(slot))
    listed = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), groups[c].combine_chunks().take(order)) for c in ("keep_id", "keep_row", "n")]
    row = [groups["bucket"][:1].combine_chunks(), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.packbits(bits).tobytes()]), pa.array([words[order].tobytes()]), *listed]
    return pa.table(row, INDEX_NAMES)


def build_history(groups: DataFrame) -> DataFrame:
    """The history's index: a row for each bucket with its hash and its slots."""
    return groups.groupBy("bucket").applyInArrow(_index, INDEX)


def _winners(words: np.ndarray, known: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, historical: bool) -> pa.Table:
    return pa.table([_binary(words), pa.array(ids, mask=~known), pa.array(rows), pa.array(counts), pa.array(np.full(len(words), historical))], WINNER_NAMES)


def _looked_up(new: pa.Table, index: pa.Table) -> pa.Table:
    """The history's digests with the better locator and all their rows, and the new digests that it lacks."""
    words = _words(b"".join(new["digest"].to_pylist()))
    fresh = _locators(*(new[c].combine_chunks() for c in ("keep_id", "keep_row", "n")))
    if not index.num_rows:
        return _winners(words, *fresh, False)
    old = index.slice(0, 1).combine_chunks()
    sizes, slots = old["levels"][0].as_py(), _words(old["digests"][0].as_py())
    bits = np.unpackbits(np.frombuffer(old["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
    held = [x.copy() for x in _locators(*(old[c].combine_chunks().flatten() for c in ("ids", "rows", "counts")))]
    slot = lookup_mph(words, sizes, bits)
    member = (slot >= 0) & (slots[slot] == words).all(axis=1)
    at = slot[member]  # distinct, as the digests are
    (has, key, row, n), (had, was, had_row, had_n) = [x[member] for x in fresh], [x[at] for x in held]
    better = (has > had) | ((has == had) & ((key > was) | ((key == was) & (row > had_row))))
    for kept, ours, theirs in zip(held, (has, key, row), (had, was, had_row), strict=False):
        kept[at] = np.where(better, ours, theirs)
    held[3][at] = had_n + n
    return pa.concat_tables([_winners(slots, *held, True), _winners(words[~member], *(x[~member] for x in fresh), False)])


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept, historical.

    ``historical`` tells which rows were taken in before; the largest id of all equal texts stays,
    whichever side it comes from.
    """
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256)).alias("digest"),
        F.coalesce(historical, F.lit(False)).alias("old"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = written(keyed, "digests")
    buckets = max(8, keyed.count() // BUCKET)
    best = F.max(F.struct(F.col("id"), F.col("row")))
    groups = (
        keyed.groupBy("old", "digest")
        .agg(best.alias("best"), F.count("*").alias("n"))
        .select("old", "digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    )
    index = build_history(groups.filter("old").drop("old"))
    winners = groups.filter("not old").drop("old").groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_looked_up, WINNERS)
    out = keyed.join(winners, "digest")
    return out.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "historical")


def keep_exact(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    flags = exact_dedup(docs, historical, id_col, text_col)
    same = flags.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col("digest").alias("_key_digest"), F.col(id_col).alias("_key_id")).agg(F.count("*").alias("_key_rows"))
    keyed = docs.withColumn("_digest", F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256)))
    return one_of_each(keyed, same, [("_digest", "_key_digest"), (id_col, "_key_id")], docs.columns)
