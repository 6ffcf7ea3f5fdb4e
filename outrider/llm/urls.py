"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join.

A listed key is a canonical URL without scheme, host and path, and an action: it fits its host and
all subdomains, for paths that start with its own. A page's possible keys are the suffixes of its
host with those prefixes of its path whose lengths the list has. The Bloom filter passes the few
that may be listed; the join with the list removes false positives, and of a page's true ones the
longest decides (of equally long ones, the one that allows).

Cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; the
same holds for very long URLs as for short ones; repeated rows are judged alike; listed keys may repeat;
an empty list or table works; other columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrider.llm.common import ascii_lower, written

BLOCK_WORDS, BITS_PER_KEY, PROBES = 8, 16, 8
#: The filter's blocks are of 64 bytes each; 2**18 make 16 MB. A longer list gives more false positives, which the join removes.
MOST_BLOCKS = 1 << 18


def bloom(listed: DataFrame, key: str = "key") -> tuple[np.ndarray, int]:
    """Words of a blocked Bloom filter of ``listed[key]``, built by aggregation, and the number of blocks."""
    blocks, wanted = 1, listed.count() * BITS_PER_KEY
    while blocks < MOST_BLOCKS and blocks * BLOCK_WORDS * 64 < wanted:
        blocks *= 2
    h = F.xxhash64(key)
    rows = listed.select(F.pmod(h, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))).alias("k"), h.alias("h"))
    bit = F.expr(f"cast(pmod(shiftrightunsigned(h, 20) + k * (shiftrightunsigned(h, 41) | 1), {BLOCK_WORDS * 64}) as int)")
    words = rows.select("block", bit.alias("bit")).groupBy("block", F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    found = words.toArrow()  # 64 bytes a block, MOST_BLOCKS at most, as columns
    table = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    table[found.column("block").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table, blocks


def maybe_listed(table: np.ndarray, keys: list[str]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), seed=42) for k in keys), np.uint64, len(keys))
    block = (h.astype(np.int64) % len(table)).astype(np.int64)
    first, step = (h >> np.uint64(20)).astype(np.int64), ((h >> np.uint64(41)) | np.uint64(1)).astype(np.int64)
    found = np.ones(len(keys), bool)
    for k in range(PROBES):
        bit = (first + k * step) % (BLOCK_WORDS * 64)
        found &= (table[block, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) == 1
    return found


def host_and_path(url) -> tuple:
    """Columns of a URL's host, A-Z lower-cased, and path up to a query or fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", url_col: str = "url", columns: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``columns``, host, path, rule and verdict of each page; ``listed`` has host, path and action."""
    rules = listed.select(ascii_lower(F.col("host")).alias("host"), "path", "action").withColumn("key", F.concat("host", "path"))
    rules = rules.groupBy("key", "host", "path").agg(F.min("action").alias("action"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # of paths: no more than a URL has characters
    table, _ = bloom(rules)
    host, path = host_and_path(F.col(url_col))
    split = pages.select(*columns, host.alias("host"), path.alias("path"))
    schema = split.select("*", F.array(F.lit("")).alias("hits"), F.array(F.lit(0)).alias("cuts")).schema
    held = pages.sparkSession.sparkContext.broadcast(table)  # 64 bytes a block, MOST_BLOCKS at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            keys, cuts, owner = [], [], []
            for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                at = 0
                while at >= 0 and h:
                    for n in lengths:
                        if n <= len(p):
                            keys.append(h[at:] + p[:n])
                            cuts.append(len(h) - at)
                            owner.append(k)
                    at = h.find(".", at) + 1 or -1
            hits: list[list[str]] = [[] for _ in hosts]
            ends: list[list[int]] = [[] for _ in hosts]
            for k in np.flatnonzero(maybe_listed(held.value, keys)).tolist() if keys else []:
                hits[owner[k]].append(keys[k])
                ends[owner[k]].append(cuts[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=[*batch.schema.names, "hits", "cuts"])

    tried = written(split.mapInArrow(probe, schema).withColumn("_row", F.monotonically_increasing_id()), "probed")
    clear = tried.filter(F.size("hits") == 0).select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    some = tried.filter(F.size("hits") > 0).select("_row", F.explode(F.arrays_zip("hits", "cuts")).alias("hit")).select("_row", F.col("hit.hits").alias("key"), F.col("hit.cuts").alias("cut"))
    true = some.join(rules.select("key", F.length("host").alias("cut"), "action"), ["key", "cut"])
    best = true.groupBy("_row").agg(F.max(F.struct(F.length("key"), -F.ascii("action"), "key", "action")).alias("best")).select("_row", "best.key", "best.action")
    judged = tried.filter(F.size("hits") > 0).join(best, "_row", "left")
    return clear.unionByName(judged.select(*columns, "host", "path", F.col("key").alias("rule"), F.coalesce("action", F.lit(default)).alias("verdict")))
