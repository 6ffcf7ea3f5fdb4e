"""Sets of word shingles as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of all texts in order, and where each text's words begin (and the last one's end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    space = _SPACE[data]
    before = np.append(True, space[:-1]) if len(data) else space
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    n = end - start
    inner = data[~space]
    offset = np.arange(len(inner)) - np.repeat(np.cumsum(n) - n, n)
    powers = np.full(int(n.max()) if len(n) else 0, _BASE)
    if len(powers):
        powers[0] = 1
        powers = np.cumprod(powers)
    value = (_FOLD[inner].astype(np.uint64) + np.uint64(1)) * powers[offset]
    sums = np.add.reduceat(value, np.cumsum(n) - n) if len(n) else np.zeros(0, np.uint64)
    return mixed(sums + n.astype(np.uint64) * _BASE), np.searchsorted(start, np.append(0, np.cumsum(lengths)))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words is one shingle, one of none has none."""
    words, begin = word_hashes(texts)
    windows = len(words) - size + 1
    every = np.zeros(max(windows, 0), np.uint64)
    for k in range(size if windows > 0 else 0):
        every += words[k : k + windows] * _ODD[k]
    every = mixed(every)
    out = []
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if high - low >= size:
            own = np.sort(every[low : high - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            own = words[low:high]
            out.append(mixed((own * _ODD[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))) if len(own) else own)
    return out


def signature(values: np.ndarray) -> bytes:
    """128 bits of a set."""
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()
