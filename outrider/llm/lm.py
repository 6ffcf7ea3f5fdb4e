"""Scoring of texts with a hidden Markov language model.

Tokens are words, A-Z lower-cased, and one end for each text. The model's symbols are the most frequent
words, the end, and for all other words a class by the word's last two bytes; a word of a class has the
share (c + 1) / (N + V + 1) of it, with the class's tokens N and distinct words V. States emit symbols.

Training is Baum-Welch over all training texts: each partition adds up the expected counts of its texts
(forwards and backwards, many texts at a time), an aggregate adds up the partitions', and the driver gets
one row for each symbol, which is a number that the model fixes. Texts longer than WINDOW are trained on in
windows, of which all but the first start from the states' overall shares. Scoring isn't cut: the scaled
forward recursion over the whole text gives its exact likelihood.

Word counts cover the corpus. Of the words, the most frequent, HEAD at most, go to all executors with their
counts; the rest of a text's words meet their counts in a join.

Cases: a null text is empty, one end; a null id is in training; repeated rows count and are scored each;
texts of any length are scored in whole; without training texts every token is unknown; other columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.llm.bpe import slices
from outrider.llm.common import small_batches, written

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words with a symbol of their own, classes for the others, and words whose counts go to all executors.
OWN, CLASSES, HEAD = 8192, 2048, 65_536
END = OWN + CLASSES
SYMBOLS = END + 1
STATES, ROUNDS, WINDOW, TOGETHER = 8, 5, 512, 1024
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000


def split(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def word_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % CLASSES


class Missing(dict):
    def __missing__(self, key):
        return -1


@dataclass
class Counts:
    """What the model knows of the words: the head's words and counts, most frequent first, totals, and the classes' totals."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def lookup(self) -> Missing:
        if not hasattr(self, "_lookup"):
            self._lookup = Missing(zip(self.words, range(len(self.words)), strict=True))
            own = np.arange(len(self.words))
            self._symbol = np.where(own < OWN, own, [word_class(w) for w in self.words]).astype(np.int64)
        return self._lookup


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) of all texts, and the number of texts under an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
            found.clear()
            return batch

        for batch in batches:
            for _, texts in slices(batch, text_col):
                rows += len(texts)
                for t in texts:
                    found.update(split(t))
                if len(found) > COUNTED:
                    yield flush()
        found[b""] = rows
        yield flush()

    return docs.select(text_col).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def summary(counts: DataFrame) -> Counts:
    words = counts.filter("length(word) > 0")
    texts = counts.filter("length(word) = 0").first()
    texts = texts.c if texts else 0
    bin_of = F.floor(F.log2(F.col("c")) * 64).cast("int")
    bins = sorted(((r[0], r[1]) for r in words.groupBy(bin_of).count().collect()), reverse=True)  # 64 for each doubling
    held = np.cumsum([n for _, n in bins])
    least = min([b for (b, _), n in zip(bins, held.tolist(), strict=True) if n <= HEAD], default=1 << 30)
    head = sorted(words.filter(bin_of >= least).collect(), key=lambda r: (-r.c, bytes(r.word)))  # HEAD at most
    names, c = [bytes(r.word) for r in head], np.array([r.c for r in head], np.int64)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, types = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for k, n, v in words.groupBy((F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int").alias("k")).agg(F.sum("c"), F.count("*")).collect():
        tokens[OWN + k], types[OWN + k] = n, v
    for k, w in enumerate(names[:OWN]):
        tokens[word_class(w)] -= c[k]
        types[word_class(w)] -= 1
    return Counts(names, c, int(total) + texts, int(distinct) + (texts > 0), texts, tokens, types)


def encoded(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """A row for each text: its symbols (two bytes each), what the head's words add, and its other words with how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        lookup = counts.lookup().__getitem__
        log_c = np.append(np.log10(counts.counts + 1.0), 0.0)
        log_class = np.log10(counts.class_tokens + counts.class_words + 1.0)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                words = [split(t) for t in texts]
                n = np.array([len(w) for w in words], np.int64)
                every = [x for w in words for x in w]
                at = np.fromiter(map(lookup, every), np.int64, len(every))
                symbol = np.append(counts._symbol, 0)[at]
                rare = np.flatnonzero(at < 0)
                symbol[rare] = [word_class(every[k]) for k in rare.tolist()]
                text = np.repeat(np.arange(len(texts)), n)
                per = lambda x: np.bincount(text, x, len(texts))  # noqa: E731, B023
                classed = symbol >= OWN
                begin = np.cumsum(n) - n
                rest: list[list] = [[] for _ in texts]
                for k, i in zip(text[rare].tolist(), rare.tolist(), strict=True):
                    rest[k].append(every[i])
                several = [Counter(r) for r in rest]
                flat = symbol.astype("<u2")
                symbols = [np.append(flat[a : a + m], np.uint16(END)).astype("<u2").tobytes() for a, m in zip(begin.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array(symbols, pa.binary()),
                        pa.array(per((at >= 0).astype(float)).astype(np.int64)),
                        pa.array(per(log_c[at])),
                        pa.array(per(np.where(classed, log_c[at] - log_class[symbol], 0.0))),
                        pa.array([list(s) for s in several], pa.list_(pa.binary())),
                        pa.array([list(s.values()) for s in several], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "held_out", "symbols", "known", "log_counts", "log_classed", "rest", "times"],
                )

    schema = "doc_id bigint, held_out boolean, symbols binary, known bigint, log_counts double, log_classed double, rest array<binary>, times array<bigint>"
    return docs.select(F.col(id_col).alias("doc_id"), "held_out", F.col(text_col)).mapInArrow(run, schema)


@dataclass
class Hmm:
    """Start, continuation and transition probabilities, and each symbol's probability in each state."""

    start: np.ndarray
    later: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(shares: np.ndarray, states: int, seed: int = 11) -> Hmm:
        random = np.random.default_rng(seed)
        emit = shares[:, None] * (0.25 + random.random((len(shares), states)))
        step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        even = np.full(states, 1 / states)
        return Hmm(even, even, step, emit / emit.sum(0))

    def updated(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray, shares: np.ndarray) -> Hmm:
        """From expected counts, each with a little of the prior."""
        emit = emit + shares[:, None]
        step, start, later = step + 1 / len(step), start + 1 / len(start), emit.sum(0)
        return Hmm(start / start.sum(), later / later.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order (longest first), all symbols position by position, and where each position begins and how many it has."""
    length = np.array([len(s) for s in sequences])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # sequences longer than each position
    begin = np.cumsum(active) - active
    flat = np.empty(int(length.sum()), np.int64)
    for k, i in enumerate(order.tolist()):
        flat[begin[: length[k]] + k] = sequences[i]
    return order, flat, begin, active


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability."""
    order, flat, begin, active = _by_time(sequences)
    out, ones = np.zeros(len(sequences)), np.ones(len(model.start))
    alpha = np.broadcast_to(model.start, (len(sequences), len(ones)))
    for t, (low, n) in enumerate(zip(begin.tolist(), active.tolist(), strict=True)):
        now = (alpha[:n] @ model.step if t else alpha) * model.emit[flat[low : low + n]]
        scale = now @ ones
        out[:n] += np.log10(scale)
        alpha = now / scale[:, None]
    result = np.empty(len(sequences))
    result[order] = out
    return result


def expected(model: Hmm, sequences: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of (symbol, state), (state, state) and (start state). ``first``: whether a sequence begins a text."""
    order, flat, begin, active = _by_time(sequences)
    step, emit = model.step.astype(np.float32), model.emit.astype(np.float32)[flat]
    ones, states = np.ones(len(step), np.float32), len(step)
    start = np.where(first[order][:, None], model.start, model.later).astype(np.float32)
    alpha, scale = np.empty((len(flat), states), np.float32), np.empty(len(flat), np.float32)
    spans = list(zip(begin.tolist(), (begin + active).tolist(), strict=True))
    for t, (low, high) in enumerate(spans):
        now = (alpha[spans[t - 1][0] : spans[t - 1][0] + high - low] @ step if t else start) * emit[low:high]
        scale[low:high] = now @ ones
        alpha[low:high] = now / scale[low:high, None]
    beta, out = np.ones((len(flat), states), np.float32), np.zeros((states, states))
    back = np.ascontiguousarray(step.T)
    for t in range(len(spans) - 1, 0, -1):
        low, high = spans[t]
        ahead = emit[low:high] * beta[low:high] / scale[low:high, None]
        before = spans[t - 1][0]
        out += alpha[before : before + high - low].T @ ahead
        beta[before : before + high - low] = ahead @ back
    gamma = alpha * beta
    gamma /= (gamma @ ones)[:, None]
    by_symbol = np.stack([np.bincount(flat, gamma[:, k], len(model.emit)) for k in range(states)], 1)
    return by_symbol, out * model.step, gamma[: spans[0][1]][first[order]].sum(0, dtype=np.float64)


def _gathered(texts: DataFrame, model) -> DataFrame:
    """Expected counts over all texts: a row for each symbol, then for each state left, then one for starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.value
        symbols, states = hmm.emit.shape
        total = np.zeros((symbols + states + 1, states))
        waiting: list[np.ndarray] = []
        begins: list[bool] = []

        def work() -> None:
            a, b, c = expected(hmm, waiting, np.array(begins))
            total[:symbols] += a
            total[symbols:-1] += b
            total[-1] += c
            waiting.clear()
            begins.clear()

        for batch in batches:
            every = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
            cut = [(len(s[k : k + WINDOW]), k == 0, s[k : k + WINDOW]) for s in every for k in range(0, len(s), WINDOW)]
            for _, begin, s in sorted(cut, key=lambda x: -x[0]):
                waiting.append(s)
                begins.append(begin)
                if len(waiting) == TOGETHER:
                    work()
            if waiting:
                work()
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, k]) for k in range(states)]], names=["row", *[f"s{k}" for k in range(states)]])

    states = [f"s{k}" for k in range(len(model.value.start))]
    found = texts.select("symbols").mapInArrow(run, "row bigint, " + ", ".join(f"{s} double" for s in states))
    return found.groupBy("row").agg(*[F.sum(s).alias(s) for s in states])


def train(texts: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over encoded texts."""
    shares = np.zeros(SYMBOLS)
    shares[: min(OWN, len(counts.words))] = counts.counts[:OWN]
    shares[OWN:END] = counts.class_tokens[OWN:END]
    shares[END] = counts.texts
    shares = (shares + 1) / (shares + 1).sum()
    hmm = Hmm.first(shares, states)
    for _ in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast(hmm)  # SYMBOLS times states
        rows = _gathered(texts, held).collect()  # as many at most
        held.destroy()
        total = np.zeros((SYMBOLS + states + 1, states))
        for r in rows:
            total[r[0]] = r[1:]
        hmm = hmm.updated(total[:SYMBOLS], total[SYMBOLS:-1], total[-1], shares)
    return hmm


def _forwards(texts: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
            order = sorted(range(len(every)), key=lambda k: -len(every[k]))
            score = np.zeros(len(every))
            for k in range(0, len(order), TOGETHER):
                part = order[k : k + TOGETHER]
                score[part] = forward(model.value, [every[i] for i in part])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(x) for x in every], pa.int64()), pa.array(score)], names=["row", "doc_id", "held_out", "known", "log_counts", "log_classed", "n_tokens", "hmm"])

    return texts.select("symbols", "row", "doc_id", "held_out", "known", "log_counts", "log_classed").mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, known bigint, log_counts double, log_classed double, n_tokens bigint, hmm double")


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each text; learns from those not held out."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = written(word_counts(marked.filter("not held_out"), text_col), "words")
    known = summary(counts)
    held = sc.broadcast(known)  # HEAD words at most
    texts = written(encoded(marked, held, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "symbols")
    hmm = train(texts.filter("not held_out"), known, states, rounds)
    each = texts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    met = each.join(counts.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"))
    rest = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rest_logs"), F.sum("times").alias("rest_known"))
    scored = _forwards(texts, sc.broadcast(hmm)).join(rest, "row", "left").fillna(0, ["rest_logs", "rest_known"])
    base = F.col("log_counts") + F.col("rest_logs") - F.col("n_tokens") * F.lit(math.log10(known.tokens + known.distinct + 1)) + F.lit(math.log10(known.texts + 1))
    return scored.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rest_known") + F.lit(int(known.texts > 0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("hmm") + F.col("log_classed") + F.col("rest_logs")).alias("score"),
    )
