import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from outrider.llm import pii
from outrider.llm.common import shared_dir

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def make(n, seed):
    random.seed(seed)
    parts = ["a@b.co", "x.y+z@mail.example.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.01.2.3", "4785380592391139", "4785 3805-9239 1139", "+1 (743) 555-3824", "+49", "@", ".", " ", "-", "é", "\U0001f600", "word", "7", "+", "\n", "a@b", "%", "(", "00"]
    return ["".join(random.choices(parts, k=random.randrange(25))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark, docs, empty):
    texts = [*make(1500, 1), "1 " * 60_000, "7" * 60_000, "a@b.co " * 3000, "a" * 100_000, "." * 50_000 + "@", "+1" + " " * 60_000, "a@b." * 20_000]
    frame = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in pii.find_personal(frame).collect()}
    for k, t in enumerate(texts):
        assert got[k] == base(t), t[:200]
    assert Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in pii.find_personal(docs).collect()) == Counter((r.doc_id, tuple(base(r.text))) for r in docs.collect())
    assert pii.find_personal(empty).count() == 0


def disclosed(texts, support, threshold):
    """Term spans by brute force, over whole documents, for strings and for kinds."""
    words = [[(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)] for t in texts]
    spans = [base(t) for t in texts]
    held = [{x for kind, s, e in own for x in (kind, (kind, t[s:e].lower()))} for t, own in zip(texts, spans, strict=True)]
    n_e, n_t, n_et = Counter(e for h in held for e in h), Counter(w for ws in words for w in {x[0] for x in ws}), Counter()
    for h, ws in zip(held, words, strict=True):
        n_et.update((e, w) for e in h for w in {x[0] for x in ws})
    total, told = len(texts), set()
    for (e, w), n in n_et.items():
        if n >= support and n_e[e] < total and math.log(n * total / (n_e[e] * n_t[w])) / math.log(total / n_e[e]) >= threshold - 1e-12:
            told.add((e, w))
    around = defaultdict(set)
    for h, ws in zip(held, words, strict=True):
        for k, (w, *_) in enumerate(ws):
            for e in h:
                if (e, w) in told:
                    around[e, w].add(tuple(x[0] for x in ws[max(0, k - 5) : k + 6]))
    out = {}
    for k, (h, ws) in enumerate(zip(held, words, strict=True)):
        some = sorted({(s, e) for w, s, e in ws if any(len(around[x, w]) >= support for x in h) and not any(a < e and s < b for _, a, b in spans[k])})
        if some:
            out[k] = some
    return out


def test_revealing_terms_equal_brute_force(spark):
    random.seed(4)
    words = ["the", "and", "with", "office", "reach", "team", "Zorblatt", "écrire", "line", "call"]
    texts = []
    for k in range(150):
        some = random.choices(words[:6] + words[8:], k=random.randrange(3, 14) if k % 10 else 600)
        if k % 3 == 0:
            some.insert(random.randrange(len(some)), random.choice(["Zorblatt jane.roe@example.com", "10.0.0.7 écrire", "bob@example.org"]))
        texts.append(" ".join(some))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find_personal(frame).collect()}
    want = disclosed(texts, pii.SUPPORT, pii.THRESHOLD)
    assert want
    assert {k: v for k, v in got.items() if v} == want
    clean = {r.doc_id: r.text for r in pii.sanitise(frame.withColumn("n_chars", F.lit(1))).collect()}
    assert not any("Zorblatt" in t and "<EMAIL>" in t for t in clean.values())
    assert not any("@example" in t for t in clean.values())


def test_rare_entities_count_by_their_kind(spark):
    random.seed(5)
    words = ["the", "and", "with", "office", "team", "line"]
    texts = [" ".join(random.choices(words, k=9)) + (f" Zorblatt user{k}@example.com" if k % 8 == 0 else "") for k in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in pii.find_personal(frame, columns=("doc_id", "text")).collect()}
    assert got == {k: ["Zorblatt"] if k % 8 == 0 else [] for k in range(80)}


def test_terms_far_from_the_entity_count(spark):
    random.seed(6)
    words = ["the", "and", "with", "office", "team", "line"]
    some = lambda n: " ".join(random.choices(words, k=n))
    texts = [f"Zorblatt {some(9)} Zorblatt {some(60)} user{k}@example.com {some(60)} Zorblatt" if k % 8 == 0 else some(80) for k in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in pii.find_personal(frame, columns=("doc_id", "text")).collect()}
    assert got == {k: ["Zorblatt"] * 3 if k % 8 == 0 else [] for k in range(80)}


def test_few_pairs_are_few_files(spark):
    random.seed(7)
    name = lambda k: "".join(chr(97 + int(d)) for d in f"{k:05}")
    told = [f"Zorblatt{name(k)}" for k in range(40)]
    texts = [" ".join(name(200 * k + j) for j in range(200)) + (f" {' '.join(random.sample(told, 40))} user{k}@example.com" if k % 8 == 0 else "") for k in range(160)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("likely-*"))
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    usual = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: len(r.spans) for r in pii.find_personal(frame).collect()}
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert got == {k: 41 if k % 8 == 0 else 0 for k in range(160)}
    (new,) = set(folder.glob("likely-*")) - before
    assert len(list(new.glob("part-*.parquet"))) == 1


def test_redaction(spark, docs, empty):
    texts = ["mail a@b.co or 1.2.3.4@x.org now", "x", "", "+1 (743) 555-3824", "é\U0001f600 4785380592391139."] + ["a@b.co " * 1500]
    frame = spark.createDataFrame([(k, t, "z", "s", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, spans string, _text string, n_chars bigint")
    out = pii.sanitise(frame)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == frame.columns
    assert [rows[k].text for k in range(5)] == ["mail <EMAIL> or <EMAIL> now", "x", "", "<PHONE>", "é\U0001f600 <CARD>."]
    assert rows[5].text == "<EMAIL> " * 1500
    assert rows[4].n_chars == len(rows[4].text) and rows[0].spans == "z" and rows[0]._text == "s"
    assert Counter(r.text for r in pii.sanitise(docs).collect()) == Counter(r.text for r in docs.collect())
    assert pii.sanitise(empty).count() == 0
