import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrider.llm import lm


def model(states, symbols, seed=0):
    random = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return lm.Hmm(norm(random.random(states)), norm(random.random(states)), norm(random.random((states, states))), norm(random.random((states, symbols))).T)


def by_paths(hmm, s, start):
    """Probability and expected counts by going through all paths of states."""
    total, emit, step, first = 0.0, np.zeros(hmm.emit.shape), np.zeros(hmm.step.shape), np.zeros(len(start))
    for path in itertools.product(range(len(start)), repeat=len(s)):
        p = start[path[0]] * math.prod(hmm.step[a, b] for a, b in itertools.pairwise(path)) * math.prod(hmm.emit[x, k] for x, k in zip(s, path, strict=True))
        total += p
        first[path[0]] += p
        for x, k in zip(s, path, strict=True):
            emit[x, k] += p
        for a, b in itertools.pairwise(path):
            step[a, b] += p
    return total, emit / total, step / total, first / total


def test_forward_and_expected_counts_equal_all_paths():
    hmm = model(3, 5)
    random = np.random.default_rng(3)
    some = [random.integers(0, 5, n) for n in (1, 6, 3, 2, 6, 1, 4)]
    first = np.array([True, False, True, True, True, False, True])
    for s, got in zip(some, lm.forward(hmm, some), strict=True):
        assert math.isclose(got, math.log10(by_paths(hmm, s, hmm.start)[0]), rel_tol=1e-12)
    emit, step, start = lm.expected(hmm, some, first)
    each = [by_paths(hmm, s, hmm.start if f else hmm.later) for s, f in zip(some, first, strict=True)]
    assert np.allclose(emit, sum(x[1] for x in each), atol=1e-4)
    assert np.allclose(step, sum(x[2] for x in each), atol=1e-4)
    assert np.allclose(start, sum(x[3] for x, f in zip(each, first, strict=True) if f), atol=1e-4)


def test_the_models_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([(1, "a b a c"), (2, "b b")], "doc_id bigint, text string")
    known = lm.summary(lm.word_counts(frame))
    assert (known.tokens, known.distinct, known.texts) == (8, 4, 2)
    hmm = lm.Hmm.first(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS), 3)
    assert np.allclose(hmm.emit.sum(0), 1) and np.allclose(hmm.step.sum(1), 1)


def base_scores(rows):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((rows[k][0], held[k], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for k, ws in words.items())


@pytest.mark.parametrize("head", [65_536, 6])
def test_base_scores(spark, docs, empty, monkeypatch, head):
    if head < lm.HEAD:
        monkeypatch.setattr(lm, "HEAD", head)
        monkeypatch.setattr(lm, "COUNTED", 3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = lm.score_documents(docs, held, rounds=1).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == base_scores([(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score_documents(empty, held, rounds=1).count() == 0
    unseen = lm.score_documents(docs, F.lit(True), rounds=1).collect()
    assert {r.n_known for r in unseen} == {0} and {r.train_tokens for r in unseen} == {0}


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm.score_documents(docs, held).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1]


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]


def in_logs(hmm, symbols):
    """log10 of a sequence's probability, by sums of logarithms over the states."""
    with np.errstate(divide="ignore"):
        start, step, emit = np.log(hmm.start), np.log(hmm.step), np.log(hmm.emit)
    alpha = start + emit[symbols[0]]
    for x in symbols[1:]:
        alpha = np.logaddexp.reduce(alpha[:, None] + step, axis=0) + emit[x]
    return np.logaddexp.reduce(alpha) / math.log(10)


@pytest.mark.parametrize("head", [65_536, 6])
def test_scores_equal_a_forward_pass_over_the_words(spark, docs, monkeypatch, head):
    """The trained model's score, from the texts: words without a symbol of their own have a share of their class."""
    monkeypatch.setattr(lm, "HEAD", head)
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    free = next(i for i in range(10_000, 20_000) if held_out(i))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None] + [(free, "neverseen words\u00fcber qqzz neverseen")]
    got = {}
    train, summary = lm.train, lm.summary
    monkeypatch.setattr(lm, "train", lambda *a, **k: got.setdefault("hmm", train(*a, **k)))
    monkeypatch.setattr(lm, "summary", lambda *a: got.setdefault("known", summary(*a)))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), held, rounds=2).collect()
    c = Counter(w for i, t in rows if not held_out(i) for w in words_of(t))
    own = {w: k for k, w in enumerate(got["known"].words[: lm.OWN])}
    assert len(own) <= head and (head > 6 or len(own) < len(c)) and all(c[w] >= 1 for w in own)
    tokens, kinds = Counter(), Counter()
    for w, n in c.items():
        if w not in own:
            tokens[lm.word_class(w)] += n
            kinds[lm.word_class(w)] += 1
    share = lambda w: 1.0 if w in own else (c[w] + 1) / (tokens[lm.word_class(w)] + kinds[lm.word_class(w)] + 1)
    symbol = lambda w: own.get(w, lm.word_class(w))

    def brute(text):
        words = words_of(text)
        return in_logs(got["hmm"], [*map(symbol, words), lm.END]) + sum(math.log10(share(w)) for w in words)

    want = sorted((i, brute(t)) for i, t in rows)
    for a, b in zip(sorted((r.doc_id, r.score) for r in scored), want, strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-8, abs_tol=1e-8)
    for k in set(tokens):  # a class's words, and one more for all unseen ones
        members = [w for w in c if w not in own and lm.word_class(w) == k]
        assert math.isclose(sum(map(share, members)) + 1 / (tokens[k] + kinds[k] + 1), 1)
    assert np.allclose(got["hmm"].emit.sum(0), 1) and np.allclose(got["hmm"].step.sum(1), 1) and math.isclose(got["hmm"].start.sum(), 1)
