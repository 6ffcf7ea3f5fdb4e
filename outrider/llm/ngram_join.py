"""Exact Jaccard self-join of documents on word shingles, by vertical partitioning.

All n-grams have one global order: by the number of different sets that have them, rare ones first, then by
hash. Sets that are similar enough share an n-gram among the first few of each (the prefix filter), and
with rare n-grams first few sets do so by chance. The order is cut into fragments: a set's part in a
fragment is one row, a pair's common n-grams are counted fragment by fragment and summed for each pair.

The order needs every n-gram's exact count, and a set needs to know only its n-grams that another set
has too: no other can be common to a pair. So the n-grams go, as packed runs of their hashes with their
owners, to ranges of the hash; there they are counted, those of one set only are left out, and the rest
goes back to ranges of their owners, where each set is put in order. N-grams that very many sets have
would meet in one range; they are found before, in a table whose size has a bound, come last in the order
and stay with their sets. A set whose first few n-grams are all its own has no partner and goes no further.

Links within a group of near copies would be as many as its pairs, so the join looks for what connects
documents. Equal sets are one to begin with. In each bucket of a prefix n-gram one set, the hub, that
has the fewest n-grams of its own, is compared with all others that lengths and positions allow; the links found give components. After that
all pairs of different components are compared that share a bucket, whose lengths and positions allow a
link. Nothing is left out: two documents end in one component exactly if links lead from one to the other.

Cases: a text without words, or null, has an empty set and is linked with nothing; fewer words than a
shingle has are one shingle; repeated rows, and rows that share an id or have none, are documents of
their own, a component's name is the smallest id in it that isn't null; very long texts are handled in
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrider.llm.bpe import slices
from outrider.llm.common import dropped, one_of_each, small_batches, split_join, written
from outrider.llm.components import components
from outrider.llm.shingles import shingle_sets, signature

#: N-grams and sets that a task packs at a time, and n-grams in a range of the hash, on average; they bound a task's memory.
PACKED, PACKED_SETS, RANGE = 1 << 22, 1 << 16, 1 << 23
#: Every n-gram in more than a 2**-HEAVY_BITS of all sets' n-grams counts as heavy, so there are 2**HEAVY_BITS at most; no n-gram in fewer sets than HEAVY does.
HEAVY_BITS, HEAVY = 20, 32
#: Counts at which the order is cut; what is heavy is one more fragment.
CUTS = (4, 16)
#: Pairs with one set that go to a task together.
TOGETHER = 1000
PACKS = "bucket int, kind int, a binary, b binary, c binary, d binary"
#: Kinds of packs: gaps, owners, owners' names; names, sizes, numbers of heavy n-grams, their places; names, numbers of n-grams, n-grams, counts.
GRAMS, OWNERS, COUNTED = 0, 1, 2


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            yield part.column(0).to_pylist(), texts, shingle_sets([t.encode() for t in texts], size)


def _name(sig: bytes) -> int:
    """A set's name while candidates are sought: the first half of its signature."""
    return int.from_bytes(sig[:8], "little", signed=True)


class Gathered:
    """Different sets, until there are enough to pack."""

    def __init__(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.total = 0

    def add(self, name: int, values: np.ndarray) -> bool:
        """Whether it is full now."""
        if name not in self.sets:
            self.sets[name] = values
            self.total += len(values)
        return self.total >= PACKED or len(self.sets) >= PACKED_SETS


def prefix_length(n, percent: int):
    """Of the ordered set, so many are looked at: a set that is similar enough shares one of them."""
    return n + (-percent * n // 100) + 1


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document, and rows (gram, times) of the n-grams that are frequent in some pack of sets."""

    def often(held: Gathered) -> Iterator[pa.RecordBatch]:
        grams, times = np.unique(np.concatenate([*held.sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
        at = np.flatnonzero(times >= max(2, held.total >> HEAVY_BITS))
        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(grams[at].view(np.int64)), pa.array(times[at].astype(np.int64))], names=names)

    names = ["doc_id", "text_md5", "n", "sig", "rep", "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for ids, texts, sets in _sets(batches, size):
            sigs = [signature(s) if len(s) else None for s in sets]
            reps = [_name(g) if g else None for g in sigs]
            md5 = [hashlib.md5(t.encode()).digest() for t in texts]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(md5, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(reps, pa.int64()), none, none], names=names)
            for rep, s in zip(reps, sets, strict=True):
                if rep is not None and held.add(rep, s):
                    yield from often(held)
                    held = Gathered()
        yield from often(held)

    return docs.mapInArrow(run, "doc_id bigint, text_md5 binary, n bigint, sig binary, rep bigint, gram bigint, times bigint")


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "a", "b", "c", "d"])


def _cuts(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, after last) of the ranges of the hash that sorted ``values`` lie in."""
    if not len(values):
        return []
    of = (values >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True))


def packed_grams(values: np.ndarray, base: int) -> bytes:
    """Sorted values as gaps, each in as many bytes as the widest needs."""
    gaps = np.diff(values, prepend=np.uint64(base))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_grams(data: bytes, count: int, base: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(count, -1)
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, : planes.shape[1]] = planes
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def _spread(docs: DataFrame, size: int, heavy, bits: int) -> DataFrame:
    """Packs of all sets' n-grams that aren't heavy for the ranges of the hash, and of the sets themselves for ranges of their names."""

    def packs(held: Gathered) -> Iterator[pa.RecordBatch]:
        if not held.sets:
            return
        known = heavy.value[0]
        names = np.array(list(held.sets), np.int64).view(np.uint64)
        sizes = np.array([len(s) for s in held.sets.values()], np.int64)
        grams = np.concatenate(list(held.sets.values()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        often = known[place] == grams if len(known) else np.zeros(len(grams), bool)
        times = np.bincount(owner[often], minlength=len(sizes))
        start = np.cumsum(times) - times
        place = place[often]
        rows = []
        order = np.argsort(names)
        for g, low, high in _cuts(names[order], bits):
            at = order[low:high]
            own = np.concatenate([place[start[k] : start[k] + times[k]] for k in at])
            rows.append((g, OWNERS, names[at].astype("<u8").tobytes(), sizes[at].astype("<u4").tobytes(), times[at].astype("<u4").tobytes(), own.astype("<u4").tobytes()))
        yield _pack(rows)
        grams, owner = grams[~often], owner[~often]
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        del order
        rows, bulk = [], 0
        there = np.zeros(len(sizes), bool)
        for g, low, high in _cuts(grams, bits):
            own = owner[low:high]
            there[:] = False
            there[own] = True
            local = np.cumsum(there) - 1
            rows.append((g, GRAMS, packed_grams(grams[low:high], g << (64 - bits)), local[own].astype("<u2").tobytes(), names[there].astype("<u8").tobytes(), None))
            bulk += 16 * (high - low)
            if bulk > 1 << 22:
                yield _pack(rows)
                rows, bulk = [], 0
        if rows:
            yield _pack(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for _, _, sets in _sets(batches, size):
            for s in sets:
                if len(s) and held.add(_name(signature(s)), s):
                    yield from packs(held)
                    held = Gathered()
        yield from packs(held)

    return docs.mapInArrow(run, PACKS)


def _shared(packs: DataFrame, bits: int) -> DataFrame:
    """Of each range of the hash the n-grams of two sets or more, with their numbers of sets, for the ranges of the sets' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, names = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            kinds = np.array(batch.column(1))
            if (kinds == OWNERS).any():
                yield batch.take(pa.array(np.flatnonzero(kinds == OWNERS)))
            for k in np.flatnonzero(kinds == GRAMS).tolist():
                bucket, gaps, owner, held = (batch.column(c)[k].as_py() for c in (0, 2, 3, 4))
                own = np.frombuffer(owner, "<u2")
                grams.append(unpacked_grams(gaps, len(own), bucket << (64 - bits)))
                names.append(np.frombuffer(held, "<u8")[own])
        s, o = np.concatenate(grams), np.concatenate(names)
        del grams, names
        order = np.argsort(s)
        s, o = s[order], o[order]
        again = s[1:] == s[:-1]
        at = np.flatnonzero(np.append(again, False) | np.append(False, again)) if len(s) else np.zeros(0, np.int64)
        s, o = s[at], o[at]
        order = np.lexsort((o, s))
        s, o = s[order], o[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])) if len(s) else np.zeros(0, bool)  # copies are one set
        s, o = s[fresh], o[fresh]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(s)))
        df = np.repeat(times, times)
        s, o, df = s[df > 1], o[df > 1], df[df > 1]
        order = np.argsort(o, kind="stable")
        s, o, df = s[order], o[order], df[order]
        for g, low, high in _cuts(o, bits):
            own, times = np.unique(o[low:high], return_counts=True)
            yield _pack([(g, COUNTED, own.astype("<u8").tobytes(), times.astype("<u4").tobytes(), s[low:high].astype("<u8").tobytes(), df[low:high].astype("<u4").tobytes())])

    return packs.repartitionById(1 << bits, "bucket").mapInArrow(run, PACKS)


def _ordered(packs: DataFrame, heavy, bits: int, percent: int) -> DataFrame:
    """Of the sets that have a shared n-gram in the prefix: fragment -1 has those n-grams, the first of which is at ``first``, the others the set's shared n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, of, grams, weight = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.uint64, np.uint64, np.int64))
        known, often = heavy.value
        for batch in batches:
            for kind, a, b, c, d in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                own, times = np.frombuffer(a, "<u8"), np.frombuffer(b if kind == COUNTED else c, "<u4")
                of.append(np.repeat(own, times))
                if kind == COUNTED:
                    grams.append(np.frombuffer(c, "<u8"))
                    weight.append(np.frombuffer(d, "<u4").astype(np.int64))
                else:
                    names.append(own)
                    sizes.append(np.frombuffer(b, "<u4").astype(np.int64))
                    place = np.frombuffer(d, "<u4")
                    grams.append(known[place])
                    weight.append((1 << 40) + often[place])
        names, first = np.unique(np.concatenate(names), return_index=True)
        n = np.concatenate(sizes)[first]
        grams, weight, rep = np.concatenate(grams), np.concatenate(weight), np.searchsorted(names, np.concatenate(of))
        order = np.lexsort((grams, weight, rep))
        grams, weight, rep = grams[order], weight[order], rep[order]
        # a set packed twice has its heavy n-grams twice
        fresh = np.append(True, (rep[1:] != rep[:-1]) | (grams[1:] != grams[:-1])) if len(rep) else np.zeros(0, bool)
        grams, weight, rep = grams[fresh], weight[fresh], rep[fresh]
        times = np.bincount(rep, minlength=len(names))
        end = np.cumsum(times)
        alone = n - times  # n-grams of no other set come first
        room = prefix_length(n, percent) - alone
        piece = np.searchsorted(CUTS, weight, "right")
        piece[weight >= 1 << 40] = len(CUTS) + 1
        out: list[tuple] = []
        for k in np.flatnonzero((room > 0) & (times > 0)).tolist():
            low, high = int(end[k] - times[k]), int(end[k])
            about = (int(names[k].view(np.int64)), int(n[k]), int(alone[k]))
            out.append((*about, -1, None, grams[low : low + int(room[k])].view(np.int64)[: high - low]))
            at = [low, *(low + np.flatnonzero(np.diff(piece[low:high])) + 1).tolist(), high]
            out += [(*about, int(piece[x]), np.sort(grams[x:y]).astype("<u8").tobytes(), None) for x, y in zip(at, at[1:], strict=False)]
            if len(out) >= 5000 or k == len(names) - 1:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rep", "n", "first", "fragment", "part", "prefix"])

    return packs.repartitionById(1 << bits, "bucket").mapInArrow(run, "rep bigint, n bigint, first bigint, fragment int, part binary, prefix array<bigint>")


def _common(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` (a, na, b, nb) with ``common``, the number of n-grams that both have. A set of many pairs meets them in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "n"])

    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    one = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(parts.select(F.col("rep").alias("a"), "fragment", F.col("part").alias("x")), "a")
    two = parts.select(F.col("rep").alias("b"), "fragment", F.col("part").alias("y"))
    dealt = split_join(pairs.select("a", "b"), heads, "a").select("a", "b", F.pmod(F.hash("b"), "salts").alias("salt"))
    met = dealt.join(two, "b").join(one, ["a", "salt", "fragment"]).select("a", "b", "x", "y")
    sums = met.mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("common"))
    return pairs.join(sums, ["a", "b"])


class JaccardJoin:
    """The state of one join: the sets and what is known of their links."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80):
        self.percent = percent
        spark = docs.sparkSession
        small_batches(spark)
        docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        self.rows = written(_signed(docs, size), "documents")
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        bits = max(1, (max(total // RANGE, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length())
        least = max(HEAVY, total >> HEAVY_BITS)
        found = self.rows.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).toArrow()  # 2**HEAVY_BITS rows at most
        grams, times = (found.column(c).to_numpy() for c in ("gram", "times"))
        order = np.argsort(grams.view(np.uint64))
        heavy = spark.sparkContext.broadcast((grams.view(np.uint64)[order], times[order]))
        self.rows = self.rows.filter("gram is null").drop("gram", "times")
        self.sets = written(_ordered(_shared(_spread(docs, size, heavy, bits), bits), heavy, bits, percent), "sets")
        heavy.unpersist()
        self.component: DataFrame | None = None

    def _fits(self, n: str, i: str, m: str, j: str):
        """Whether sets of n and m, whose first common n-gram is at i and j, can be similar enough."""
        p = self.percent
        least = F.col(n) + F.col(m)
        return ((F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (100 + p)) >= least * p) & (100 * F.least(F.col(n), F.col(m)) >= p * F.greatest(F.col(n), F.col(m)))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs that are similar enough."""
        pairs = written(pairs, "pairs")
        counted = _common(pairs, self.sets.filter("fragment >= 0").select("rep", "fragment", "part"))
        found = written(counted.filter(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        dropped(pairs)
        return found

    def _with_component(self, rows: DataFrame) -> DataFrame:
        named = self.component.select(F.col("node").alias("rep"), "component")
        return rows.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def run(self) -> None:
        rows = self.sets.filter("fragment = -1").select("rep", "n", "first", F.posexplode("prefix").alias("k", "s")).select("s", "rep", "n", "first", (F.col("first") + F.col("k")).alias("i"))
        # the fewest n-grams of its own: what the others were copied from, if it is there
        hubs = rows.groupBy("s").agg(F.count("*").alias("c"), F.min(F.struct("first", "rep", "n", "i")).alias("h")).filter("c > 1")
        buckets = written(split_join(rows.drop("first"), hubs.select("s", F.col("h.rep").alias("hub"), F.col("h.n").alias("m"), F.col("h.i").alias("j")), "s"), "buckets")
        near = buckets.filter((F.col("rep") != F.col("hub")) & self._fits("n", "i", "m", "j"))
        links = self._links(near.select(F.col("hub").alias("a"), F.col("m").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct())
        self.component = components(links)
        more = self._links(self._rest(buckets))
        if more.head(1):
            every = self.component.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
            before, self.component = self.component, components(every)
            dropped(before)
        for done in (buckets, links, more):
            dropped(done)

    def _rest(self, buckets: DataFrame) -> DataFrame:
        """All pairs of different components that share a bucket and may be linked; one of each pair is outside its bucket's largest component."""
        rows = self._with_component(buckets.select("s", "rep", "n", "i"))
        parts = rows.groupBy("s", "component").agg(F.count("*").alias("c"))
        mixed = parts.groupBy("s").agg(F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("top")).filter("k > 1")
        left = split_join(rows, mixed.select("s", F.col("top.component").alias("major")), "s")
        few = left.filter("component <> major")
        other = left.select("s", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("i").alias("j"), F.col("component").alias("_other"))
        met = few.join(other, (few["s"] == other["s"]) & (few["component"] != F.col("_other")) & self._fits("n", "i", "nb", "j"))
        ends = met.select(F.struct("rep", "n").alias("x"), F.struct(F.col("b").alias("rep"), F.col("nb").alias("n")).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return ends.select(F.col("x.rep").alias("a"), F.col("x.n").alias("na"), F.col("y.rep").alias("b"), F.col("y.n").alias("nb")).distinct()

    def documents(self) -> DataFrame:
        """(doc_id, text_md5, n_shingles, component_id, component) of every document; no component without words."""
        sets = self._with_component(self.rows.filter("n > 0").groupBy("rep").agg(F.min("doc_id").alias("low")))
        names = sets.groupBy("component").agg(F.min("low").alias("component_id"))
        named = split_join(sets, names, "component").select("rep", "component_id", "component")
        some = self.rows.filter("n > 0").join(named, "rep").select("doc_id", "text_md5", "n", "component_id", "component")
        none = self.rows.filter("n = 0").select("doc_id", "text_md5", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("component"))
        return some.unionByName(none).withColumnRenamed("n", "n_shingles")

def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every document; see the module."""
    join = JaccardJoin(docs, id_col, text_col, size, percent)
    join.run()
    return join.documents().select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the smallest id (then text hash; any of rows equal in both), and all rows without words."""
    join = JaccardJoin(docs, id_col, text_col, size, percent)
    join.run()
    found = written(join.documents().filter("component is not null"), "components")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")).alias("b")).select(F.col("b.doc_id").alias("_key_id"), F.col("b.text_md5").alias("_key_md5"))
    times = found.groupBy("doc_id", "text_md5").agg(F.count("*").alias("_key_rows"))
    chosen = best.join(times, best["_key_id"].eqNullSafe(times["doc_id"]) & (best["_key_md5"] == times["text_md5"])).select("_key_id", "_key_md5", "_key_rows")
    has_word = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(has_word).withColumn("_md5", F.unhex(F.md5(F.col(text_col).cast("binary"))))
    return one_of_each(keyed, chosen, [("_md5", "_key_md5"), (id_col, "_key_id")], docs.columns).unionByName(docs.filter(~has_word))
