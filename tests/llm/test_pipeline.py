"""The corpus pipeline against brute force, stage by stage, each on its own input."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline
from test_dedup_shards_urls import digest
from test_ngram_join import brute
from test_packing_bpe import one_by_one
from test_pii import base, disclosed
from test_quality import measured

from outrider.llm import pii, quality

FOLDER = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def stays(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    marked = len(re.findall(r"(?:[#*$%&|<>]|!!+)[^\x20\x09-\x0D]*", line))
    return bool(re.search(quality.SENTENCE_MARK, line)) and not re.search(quality.NAVIGATION, line) and not re.search(quality.BOILERPLATE, line) and marked <= 0.3 * len(words)


def cleaned(text):
    """The clean text, or None if it is rejected."""
    n, chars, _, _, again = measured(text)
    if n < 50 or 100 * again > 50 * n:
        return None
    kept = "\n".join(x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and stays(x))
    return kept if chars - measured(kept)[1] <= 0.5 * chars else None


def redacted(text, spans):
    out, done = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if start >= done:
            out.append(text[done:start] + ("" if kind == pii.TERM else f"<{kind.upper()}>"))
        done = max(done, end)
    return "".join(out) + text[done:]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (None, "", "en", "x", 0), (9002, docs.first().text, "en", "x", 1), (9002, docs.first().text, "en", "x", 1)], docs.schema)
    held = [docs.unionByName(extra).collect()]
    now = spark.createDataFrame(held[0], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, FOLDER).collect()
        held.append(rows)
        if stage is not corpus_pipeline.packed:
            assert rows[0].__fields__ == NAMES
            now = spark.createDataFrame(rows, docs.schema)
    return held


def test_quality(stages):
    want = Counter((r.doc_id, c) for r in stages[0] if (c := cleaned(r.text)) is not None)
    assert Counter((r.doc_id, r.text) for r in stages[1]) == want
    assert all(r.n_chars == len(r.text) for r in stages[1])


def test_exact(stages):
    best = {}
    for r in stages[1]:
        best[digest(r.text)] = max(best.get(digest(r.text), -1), r.doc_id)
    assert Counter((r.doc_id, digest(r.text)) for r in stages[2]) == Counter((i, d) for d, i in best.items())


def test_near(stages):
    names = brute([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == sorted({c for _, _, c in names})
    assert len(stages[3]) < len(stages[2])


def test_personal(stages):
    texts = [r.text for r in stages[3]]
    terms = disclosed(texts, pii.SUPPORT, pii.THRESHOLD)
    want = Counter((r.doc_id, redacted(r.text, base(r.text) + [(pii.TERM, *s) for s in terms.get(k, [])])) for k, r in enumerate(stages[3]))
    assert Counter((r.doc_id, r.text) for r in stages[4]) == want


def test_packing(stages):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*real.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in stages[4]}
    seen, windows = Counter(), {}
    for r in stages[5]:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == Counter({k: len(v) for k, v in ids.items()})
    assert len(windows) == len(one_by_one([r.length for r in stages[5]], 1024))


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, FOLDER).collect(), now.schema if stage is not corpus_pipeline.packed else None)
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset").collect())) == Counter(map(tuple, now.drop("sequence_id", "offset").collect()))
