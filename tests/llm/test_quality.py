import random
import re
from collections import Counter

from pyspark.sql import functions as F

from outrider.llm import quality


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_equal_brute_force(spark, docs, empty):
    random.seed(3)
    parts = ["a", "b", "c", "Ab.", "\n", " ", "\t", "#", "é!", "\x0b", " ", " ", "x\n"]
    texts = ["".join(random.choices(parts, k=random.randrange(80))) for _ in range(400)] + ["a b c a b c", "a a a a", "a b c", "a b"]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, kept_by string")
    for given in (frame, docs):
        rows = quality.judge_lines(given.withColumn("own", F.col("text"))).collect()
        for r in rows:
            assert tuple(r[c] for c in NAMES) == measured(r.own)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge_lines(empty).count() == 0


def test_ends_of_lines_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from outrider.llm import queries

    ends = ["", "\r", "\x85", "\u2028", "\u2029", "\x0b", " ", '"', "\u00a0", "x"]
    rows = [(k, "\n".join(" ".join(f"w{k}x{j}y{i}" for i in range(9)) + mark + end for j in range(8))) for k, (mark, end) in enumerate((m, e) for m in (".", "!", "…", "") for e in ends)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op5_line_first_quality(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(db.execute(queries.OP5_SQL).fetchall())
    assert {r[7] for r in got} == {True, False}


def test_very_many_lines(spark):
    text = "\n".join(f"line{k} has{k} words{k} enough{k}, number {k * 7}." for k in range(8000))
    row = quality.judge_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert tuple(row[c] for c in NAMES) == measured(text) and row.kept and row.lost_chars == 0


def test_lines_and_documents(spark):
    body = [" ".join(f"w{k * 31 + j}" for j in range(9)) + ", end." for k in range(12)]
    rows = {
        1: "\n".join(body),
        2: "\n".join([*body, "Home | News | Sport | About us", "All rights reserved.", "no mark at all here"]),
        3: "\n".join(" ".join(f"{w}###" for w in line.split()) for line in body),
        4: "\n".join(line.upper().replace(" ", "!! ") + "!!" for line in body),
        5: " | ".join(f"cell{k}" for k in range(80)) + ".",
        6: "\n".join(body[:2]),
    }
    frame = spark.createDataFrame([(k, t, "s", "k", 3) for k, t in rows.items()], "doc_id bigint, text string, source string, kept string, n_chars bigint")
    kept = {r.doc_id: r for r in quality.keep_clean(frame).collect()}
    assert sorted(kept) == [1, 2]
    assert kept[1].text == kept[2].text == rows[1]
    assert kept[2].n_chars == len(rows[1])
    assert kept[1].kept == "k"
    assert quality.keep_clean(frame).columns == frame.columns
    assert quality.keep_clean(frame.limit(0)).count() == 0
