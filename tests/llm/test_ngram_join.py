import random
import re
from collections import Counter

import numpy as np
import pytest

from outrider.llm import ngram_join, shingles
from outrider.llm.components import components


def shingled(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and sets[b]:
                parent[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return Counter((i, len(sets[k]), low.get(top(k))) for k, (i, _) in enumerate(rows))


def make(seed, n):
    random.seed(seed)
    passage = [f"p{k}" for k in range(40)]
    bases = [[f"b{b}x{random.randrange(10**6)}" for _ in range(random.choice([3, 8, 40, 90]))] for b in range(12)]
    rows = []
    for k in range(n):
        kind = random.random()
        if kind < 0.6:
            words = list(random.choice(bases[:3] if kind < 0.3 else bases))
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
        else:
            words = [f"u{random.randrange(10**6)}" for _ in range(random.choice([2, 6, 10, 60]))]
        if random.random() < 0.3:
            at = random.randrange(len(words) + 1)
            words[at:at] = passage
        text = " ".join(w.upper() if random.random() < 0.1 else w for w in words)
        rows.append((k, text))
    return rows


def test_sets():
    texts = ["a b c d e f", "A  b\tc d\ne F", "a b", "", "  ", "é Ü x y z é Ü x y z é Ü", "a b c d e", "ab"]
    got = shingles.shingle_sets([t.encode() for t in texts])
    assert [len(x) for x in got] == [len(shingled(t)) for t in texts]
    assert (got[0] == got[1]).all()
    many = [t for _, t in make(9, 300)]
    together = shingles.shingle_sets([t.encode() for t in many])
    for t, x in zip(many, together, strict=True):
        assert (shingles.shingle_sets([t.encode()])[0] == x).all()
    for a in range(0, 300, 7):
        for b in range(0, 300, 11):
            assert len(set(together[a].tolist()) & set(together[b].tolist())) == len(shingled(many[a]) & shingled(many[b]))


def test_packed_grams():
    rng = np.random.default_rng(6)
    for n, low, high in ((1, 0, 1), (1, 5, 6), (70, 0, 2**64 - 1), (900, 2**63, 2**63 + 950), (5, 2**63, 2**64 - 1)):
        values = np.unique(rng.integers(low, high, n, np.uint64))
        assert (ngram_join.unpacked_grams(ngram_join.packed_grams(values, low), len(values), low) == values).all()


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 400):
        p = ngram_join.prefix_length(n, 80)
        assert p == n - -(-80 * n // 100) + 1


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert all(got.get(x, x) == label[x] for x in label)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize(("seed", "heavy"), [(1, 32), (2, 4)])
def test_join_equals_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "TOGETHER", heavy)
    monkeypatch.setattr(ngram_join, "RANGE", 100 * heavy)
    rows = make(seed, 350)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(frame).collect())
    assert got == brute(rows)


def test_odd_documents(spark, docs, empty):
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low = {c for _, n, c in brute(rows) if n and c is not None}
    names = Counter(r.doc_id for r in kept.collect())
    blank = Counter(i for i, t in rows if not (t or "").strip())
    assert {i for i in names - blank if i is not None} == low
    assert max((names - blank).values()) == 1 and (names - blank)[None] == 1
    assert ngram_join.keep_one(empty).count() == 0
