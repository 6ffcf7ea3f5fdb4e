"""Byte-level BPE in batched numpy merge rounds, and back.

A batch's distinct words lie in one flat array of symbols. In a round, the rank of every new
adjacent pair is found by binary search over the sorted pair keys, all places merge whose pair has
the lowest rank of all that could touch it, and words without any pair that could merge leave the
array. Since a merge's result only takes part in merges of higher rank, merging all places of a pair
in one round gives what merging one place at a time gives. What could touch a place lies within the
length of the longest token that merges of lower rank make: to take one of its two symbols first, a
neighbour has to be such a token, and to grow it needs a pair of lower rank in its own span. In a
word no longer than the longest token that is the whole word; a longer one merges in many places at once.

Cases: a null text is empty and has no ids; an empty table gives an empty result; repeated rows are
encoded alike; texts are split only for memory, at places where no word crosses; other columns stay
unread.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from outrider.llm.common import small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are remembered from batch to batch, at most, and the bytes of text in a batch.
REMEMBERED, SLICE = 300_000, 1_000_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies have for bytes: printable Latin-1 is itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for the JSON file of a byte-level BPE tokenizer."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: By rank, the length of the longest token that merges of lower rank make.
        self.reach = np.maximum.accumulate(np.append(2, self.lengths[self.results])[: len(self.results)])
        self.flat_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, one after another, and the number of each word's ids."""
        count = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), count)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._ranked(word, sym, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least != NONE, sizes)
            if not live.all():
                done.append((word[~live], sym[~live]))
                word, sym, rank, sizes, least = word[live], sym[live], rank[live], sizes[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            lowest = np.repeat(least, sizes)
            wide = np.repeat(sizes > self.reach[-1], sizes)
            if wide.any():
                lowest[wide] = self._lowest_nearby(rank[wide])
            place = np.flatnonzero(rank == lowest)
            fresh = np.append(True, np.diff(place) != 1)
            run = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
            whole = (run == 0) | (rank[run - 1] != rank[run])  # a run that begins further left, where it isn't settled yet, waits
            place = place[whole & ((place - run) % 2 == 0)]
            sym[place] = self.results[rank[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            word, sym, rank = word[keep], sym[keep], rank[keep]
            fresh_at = place - np.arange(len(place))  # of the places before it each has lost one symbol
            changed = np.concatenate([fresh_at, fresh_at[fresh_at > 0] - 1])
            rank[changed] = self._ranked(word, sym, changed)
        if not done:
            return sym, np.bincount(word, minlength=len(words))
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _ranked(self, word: np.ndarray, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; NONE where there is none."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (word[at] == word[after]) & (after != at), self.ranks[found], NONE)

    def _lowest_nearby(self, rank: np.ndarray) -> np.ndarray:
        """The least rank within reach of each place that is below neither neighbour; -1 at other places and those without a pair.

        Minima of windows as long as a power of two are made one from the other; two of them cover any reach.
        """
        ends = np.concatenate([[NONE], rank, [NONE]])
        at = np.flatnonzero((rank != NONE) & (rank <= ends[:-2]) & (rank <= ends[2:]))
        low = np.maximum(at - self.reach[rank[at]], 0)
        high = np.minimum(at + self.reach[rank[at]] + 1, len(rank))
        level, found = np.log2(high - low).astype(np.int64), np.empty(len(at), np.int64)
        least = np.minimum(rank, np.iinfo(np.int32).max).astype(np.int32)
        for k in range(int(level.max(initial=0)) + 1):
            if k:
                least = np.minimum(least[: -(1 << k - 1)], least[1 << k - 1 :])
            own = level == k
            found[own] = np.minimum(least[low[own]], least[high[own] - (1 << k)])
        out = np.full(len(rank), -1, np.int64)
        out[at] = found
        return out

    def _learn(self, fresh: list[str]) -> None:
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
        ids, n = self.merged([w.encode() for w in fresh])
        base = len(self.ids)
        self.known.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
        self.at = np.concatenate([self.at, base + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, one after another, and the number of each text's ids."""
        pieces: list[list[str]] = []
        specials: dict[int, int] = {}
        at = 0
        for text in texts:
            found = []
            for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
                if k % 2:
                    specials[at + len(found)] = self.special[part]
                    found.append("")
                elif part:
                    found += self.words.findall(part)
            pieces.append(found)
            at += len(found)
        every = [w for found in pieces for w in found]
        if fresh := [w for w in dict.fromkeys(every) if w and w not in self.known]:
            before = len(self.known)
            self._learn(fresh)
            if len(self.known) < before + len(fresh) and (again := [w for w in dict.fromkeys(every) if w and w not in self.known]):
                self._learn(again)
        known = self.known
        which = np.fromiter((known[w] if w else -1 for w in every), np.int64, len(every))
        n, start = self.n[which] if len(self.n) else np.zeros(len(which), np.int64), self.at[which] if len(self.at) else np.zeros(len(which), np.int64)
        if specials:
            n, start = n.copy(), start.copy()
            places = np.fromiter(specials, np.int64, len(specials))
            n[places] = 1
            start[places] = len(self.ids) + np.arange(len(places))
            source = np.concatenate([self.ids, np.fromiter(specials.values(), np.int64, len(specials))])
        else:
            source = self.ids
        ids = source[_runs(start, n)]
        per = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(np.append(0, n))[np.cumsum(np.append(0, per))]
        return ids, np.diff(ends)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.flat_bytes[_runs(self.starts[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0]+1, ... (n[0] of them), then those of start[1], ..."""
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with their texts, about SLICE bytes at a time, but one text at least."""
    column = batch.column(batch.schema.get_field_index(text_col))
    size = np.cumsum(np.array(pc.binary_length(column).fill_null(0), np.int64))
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SLICE, "right")))
        part = batch.slice(low, high - low)
        yield part, [x or "" for x in column.slice(low, high - low).to_pylist()]
        low = high


@functools.lru_cache(maxsize=2)
def loaded(content: bytes) -> ByteBpe:
    return ByteBpe(content)


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, row, schema: str, id_col: str = "doc_id", text_col: str = "text", load: Callable[[bytes], ByteBpe] = loaded) -> DataFrame:
    """``row(bpe, doc_id, ids, text)`` gives a document's rows, as tuples of ``schema``.

    ``load`` makes the encoder from the tokenizer file's content, once for each worker. The tokenizer file is read on the driver and sent to the executors, which need no copy of it.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))  # as long as the file
    arrow = _arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                ids, n = bpe.encode(texts)
                ends = np.cumsum(n)
                rows = []
                for doc, text, low, high in zip(part.column(0).to_pylist(), texts, (ends - n).tolist(), ends.tolist(), strict=True):
                    rows += row(bpe, doc, ids[low:high], text)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col]).mapInArrow(run, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the text that they decode to."""
    return encode_documents(docs, tokenizer, lambda bpe, doc, ids, _: [(doc, ids.astype(np.int32), bpe.decode(ids))], f"{id_col} bigint, ids array<int>, decoded string", id_col, text_col)
