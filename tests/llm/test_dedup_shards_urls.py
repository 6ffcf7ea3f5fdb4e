import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from outrider.llm import exact_dedup, sharding, urls


def digest(text):
    return hashlib.sha256((text or "").translate({c: c + 32 for c in range(65, 91)}).encode()).hexdigest()


def test_mph_is_minimal_and_perfect():
    for n in (0, 1, 5, 3000):
        words = np.frombuffer(os.urandom(32 * n), "<u8").reshape(-1, 4)
        sizes, bits, slot = exact_dedup.build_mph(words)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact_dedup.lookup_mph(words, sizes, bits) == slot).all()
        other = np.frombuffer(os.urandom(32 * 500), "<u8").reshape(-1, 4)
        found = exact_dedup.lookup_mph(other, sizes, bits)
        assert ((found >= -1) & (found < max(n, 1))).all()


def test_exact_dedup(docs, empty):
    split = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    rows = exact_dedup.exact_dedup(docs, split).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(digest(r.text), []).append(r.doc_id)
    got = {}
    for r in rows:
        got.setdefault(bytes(r.digest).hex(), []).append(r)
    assert {k: Counter(x.doc_id for x in v) for k, v in got.items()} == {k: Counter(v) for k, v in groups.items()}
    for k, v in got.items():
        assert sum(x.kept for x in v) == 1
        best = max((i for i in groups[k] if i is not None), default=None)
        assert {x.keep_id for x in v} == {best}
        assert next(x for x in v if x.kept).doc_id == best
        assert {x.group_size for x in v} == {len(v)}
    for history in (F.lit(True), F.lit(False)):
        assert sorted((str(r.doc_id), r.kept) for r in exact_dedup.exact_dedup(docs, history).collect()) == sorted((str(r.doc_id), r.kept) for r in rows)
    kept = exact_dedup.keep_exact(docs, split)
    assert kept.columns == docs.columns
    assert Counter(map(digest, [r.text for r in kept.collect()])) == Counter(groups.keys())
    assert exact_dedup.exact_dedup(empty, split).count() == 0
    assert exact_dedup.keep_exact(empty, split).count() == 0


def test_exact_dedup_keeps_all_digits_of_ids(spark):
    rows = [(2**60 + 1, "a"), (2**60 + 2, "A"), (None, "a"), (None, None), (2**60 + 3, "b"), (-(2**62) - 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for history in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, history).collect())
        most = 2**60 + 2
        assert got == Counter([(2**60 + 1, most, 3, False), (most, most, 3, True), (None, most, 3, False), (None, -(2**62) - 1, 2, False), (-(2**62) - 1, -(2**62) - 1, 2, True), (2**60 + 3, 2**60 + 3, 1, True)])


def walked(counts, shards, nodes):
    """The ring walked row by row: at home first, then clockwise."""
    positions = sharding.ring_positions(shards, nodes)
    points = sharding.ring(shards, nodes, positions)
    total = sum(c for *_, c in counts)
    free = sharding.capacities(total, shards, 0)
    over, held = [[] for _ in points], Counter()
    for position, sub, count in sorted(counts):
        node = next((k for k, (p, _) in enumerate(points) if p >= position), 0)
        for rank in range(count):
            if free[points[node][1]]:
                free[points[node][1]] -= 1
                held[position, sub, rank, points[node][1]] += 1
            else:
                over[node].append((position, sub, rank))
    queue = []
    for step in range(2 * len(points)):
        shard = points[step % len(points)][1]
        while queue and free[shard]:
            free[shard] -= 1
            held[(*queue.pop(0), shard)] += 1
        if step < len(points):
            queue += over[step]
    return held


def test_ring_deals_as_walked():
    random.seed(1)
    for shards in (1, 3, 16):
        cells = {(random.randrange(4096), random.randrange(4)) for _ in range(300)}
        counts = [(*c, random.choice([1, 2, 3, 500])) for c in sorted(cells)]
        got = Counter()
        for position, sub, low, high, _, shard, _ in sharding.deal(counts, shards, 8):
            for rank in range(low, high):
                got[position, sub, rank, shard] += 1
        assert got == walked(counts, shards, 8)


def test_shards(docs, empty):
    rows = sharding.shard_bounded(docs, F.col("doc_id"), 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    loose = sharding.shard_bounded(docs, F.col("doc_id"), 5, slack=0.5).collect()
    assert sum(r.home == r.shard for r in loose) >= sum(r.home == r.shard for r in rows)
    assert sharding.shard_bounded(empty, F.col("doc_id"), 5).count() == 0


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    from outrider.llm.queries import URL_RULES

    random.seed(2)
    hosts = ["net", "example.net", "a.EXAMPLE.net", "notexample.net", "b.c.example.com", "x.org", "org", "", "a..net", "net.", "u@x.net", "x.net:80"]
    paths = ["", "/", "/en/", "/en", "/en/1?a=/de/", "/de/x#y", "/fr/", "?q=1", "#f", "/EN/x", "/\n/en/"]
    made = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "//", "") for h in hosts for p in paths] + [None, "", "http://x://y/en/", "https://" + "a." * 3000 + "net/" + "p" * 9000]
    pages = spark.createDataFrame([(k if k % 50 else None, u, "h", "clash") for k, u in enumerate(made)], "page_id bigint, url string, key string, hits string")
    pages = pages.unionByName(pages)
    rules = spark.createDataFrame(URL_RULES + URL_RULES[:1], "host string, path string, action string")
    got = Counter(tuple(r) for r in urls.judge(pages, rules).collect())
    want = Counter()
    for r in pages.collect():
        want[(r.page_id, *judged(r.url, URL_RULES))] += 1
    assert got == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_one_key_with_a_third_of_the_rows(spark):
    rows = [(7, "the same")] * 400 + [(None, None)] * 100 + [(k, f"text {k % 5}") for k in range(1000, 1700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shard_bounded(docs, F.col("doc_id"), 16).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
