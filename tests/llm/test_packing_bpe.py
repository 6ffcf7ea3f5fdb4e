import random
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from outrider.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)


def test_merge_rounds_equal_the_library():
    random.seed(5)
    coder = bpe.loaded(bpe.read_spec(PATH))
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "1", "2024", "'s", "'", "!", "<|endoftext|>", "\U0001f600", "x" * 30, "aaaa", "\t", "\r\n", "中文", "\u0301", "A"]
    texts = ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(1500)] + ["", "a" * 5000, "ab" * 3000, "<|endoftext|>" * 3]
    ids, n = coder.encode(texts)
    ends = np.cumsum(n)
    for text, low, high in zip(texts, ends - n, ends, strict=True):
        want = REAL.encode(text, add_special_tokens=False).ids
        assert ids[low:high].tolist() == want
        assert coder.decode(ids[low:high]) == REAL.decode(want, skip_special_tokens=False)
    fast, m = packing.encoder(bpe.read_spec(PATH)).encode(texts)
    assert (fast == ids).all() and (m == n).all()


def test_long_words_merge_in_rounds():
    random.seed(6)
    coder = bpe.ByteBpe(bpe.read_spec(PATH))
    common = ["a", "b", "ab", "the", "ing", "tion", "er", "x", "aaa", "th", "zq"]
    words = [
        "a" * 40_001,
        "ab" * 9_000 + "a",
        "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)),
        "".join(random.choices("aab", k=20_000)),
        "".join(random.choices(common, k=12_000)),
        "".join(random.choices("中文字符語言", k=9_000)),
        "".join(random.choices("0123456789", k=9_000)),
        "=-" * 7_000 + "=" * 5_001,
        " " * 30_000,
        *["".join(random.choices(random.sample(common, 3), k=random.randrange(100, 900))) for _ in range(300)],
    ]
    ids, n = coder.encode(words)
    ends = np.cumsum(n)
    for text, low, high in zip(words, ends - n, ends, strict=True):
        assert ids[low:high].tolist() == REAL.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    coder = bpe.ByteBpe(bpe.read_spec(PATH))
    for k in range(12):
        texts = [" ".join(f"w{k}x{j}" for j in range(9)), "same again"]
        ids, n = coder.encode(texts)
        assert ids[: n[0]].tolist() == REAL.encode(texts[0], add_special_tokens=False).ids
        assert ids[n[0] :].tolist() == REAL.encode(texts[1], add_special_tokens=False).ids


def test_documents(docs, empty):
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, PATH).collect()}
    want = {(r.doc_id, tuple(REAL.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in docs.collect()}
    assert got == want
    assert bpe.encode_decode(empty, PATH).count() == 0


def one_by_one(lengths, window):
    """Best-fit decreasing, piece by piece."""
    open_, used = [], []
    for length in sorted(lengths, reverse=True):
        k = bisect_left(open_, (length, -1))
        if k == len(open_):
            used.append([length])
            room, at = window - length, len(used) - 1
        else:
            room, at = open_.pop(k)
            used[at].append(length)
            room -= length
        if room:
            insort(open_, (room, at))
    return sorted(tuple(u) for u in used)


def test_plan_is_best_fit_decreasing():
    for seed in range(60):
        random.seed(seed)
        window = random.choice([7, 16, 50, 100])
        lengths = [random.randint(1, window if seed % 2 else window // 3) for _ in range(random.randrange(1, 400))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        got, filled = {}, {}
        for length, low, high, first, offset, each in packing.best_fit_decreasing(counts, window):
            for rank in range(low, high):
                at = first + (rank - low) // each
                start = offset + (rank - low) % each * length
                got.setdefault(at, []).append(length)
                filled.setdefault(at, []).append((start, length))
            counts[length] -= high - low
        assert not any(counts.values())
        # which of several windows with the same room is taken is free; how full the windows get is not
        assert sorted(map(sum, got.values())) == sorted(map(sum, one_by_one(lengths, window)))
        for parts in filled.values():
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
            assert end <= window


def test_pack(docs, empty):
    pieces = packing.token_pieces(docs, PATH, 64)
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == pieces.count()
    by_seq = {}
    for r in rows:
        assert len(r.ids) == r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end <= 64
    assert len(by_seq) == len(one_by_one([r.length for r in rows], 64))
    text = next(r for r in docs.collect() if r.doc_id == 5).text
    own = sorted((r.start, r.ids) for r in rows if r.doc_id == 5)
    assert [i for _, ids in own for i in ids] == [*REAL.encode(text, add_special_tokens=False).ids, 0]
    assert packing.pack(packing.token_pieces(empty, PATH, 64), 64).count() == 0


def test_columns_with_clashing_names(spark):
    rows = [(k, f"some text {k}", "x", 1, 2, "y", 3) for k in range(20)] + [(20, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int, length_ int, decoded string, offset int")
    bare = docs.select("doc_id", "text")
    for made in (lambda d: bpe.encode_decode(d, PATH), lambda d: packing.pack(packing.token_pieces(d, PATH, 16), 16).select("doc_id", "start", "length", "ids")):
        assert made(docs).columns == made(bare).columns
        assert sorted(map(str, made(docs).collect())) == sorted(map(str, made(bare).collect()))
