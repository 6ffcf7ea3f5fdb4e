"""Personal data: patterns, then information-theoretic sanitisation of what gives it away.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. The corpus then
tells which other words reveal them. Each string is protected, and each kind as a whole, since most strings
are too rare to count anything by. For an entity e and a term t of the same documents, the pointwise
mutual information of the two, taken over documents, is compared with the information of e itself:
``log(n_et * D / (n_e * n_t)) / log(D / n_e)`` is 1 for a term that is found only with e and 0 for one
that tells nothing. Terms above a threshold, seen with e in several documents and several different surroundings
(copies of a passage are one), are spans too, wherever they stand in a document that holds e. Entities are
generalised to their kind; revealing terms are removed.

Positions come from the texts between matches, so everything is column expressions. The statistics are
aggregates over all documents. Quantifiers are possessive where nothing after them could take characters
back, so no text makes the matcher recurse; a match starts at the first character of its run or where the
match before it ended, so none makes it quadratic.

Cases: a null text is empty and has no spans; repeated rows are each treated alike; very long texts and texts
with very many matches work; an empty table gives an empty result; other columns stay or aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.llm.common import text_of, written
from outrider.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Patterns, equal to the plain ones in what they match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERMS = r"\p{L}{3,}"
#: Terms on either side that make a term's surrounding, different surroundings and documents that a term needs, and the threshold.
NEAR, SUPPORT, THRESHOLD = 5, 3, 0.8
BLOCK = 256


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``op`` over all elements before each one, in blocks, as appending to an array copies it."""

    def scan(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("now"), F.array(start).alias("all"))

        def step(acc: Column, v: Column) -> Column:
            now = op(acc["now"], v)
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(x, first, step)

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero))
        return let(cut, lambda c: let(scan(F.transform(c, lambda x: x["now"]), zero)["all"], lambda s: F.flatten(F.transform(c, lambda x, k: F.transform(F.slice(x["all"], 1, F.size(x["all"]) - 1), lambda y: op(F.get(s, k), y))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.slice(F.array(zero), 1, 0)).otherwise(blocks(v)))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches, in code points."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(F.transform(found, lambda m, k: F.length(F.get(gaps, k)) + F.length(m)), lambda n: let(running(n, lambda a, b: a + b, F.lit(0)), lambda at: spans(found, gaps, at))))

    def spans(found: Column, gaps: Column, at: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            start = F.get(at, k) + F.length(F.get(gaps, k))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

        return F.transform(found, one)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(placed(found)))


def luhn(digits: Column) -> Column:
    """Whether a string of 19 digits at most passes the check of card numbers."""
    one = lambda d, k: let(d.cast("int") * F.when((F.length(digits) - k) % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "email":
        return F.lit(True)
    bare = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(bare).between(8, 15)
    return F.when(F.length(bare).between(16, 19), let(bare, luhn)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """All valid spans, by kind as listed, then start; ``kind`` is the number of the kind."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(F.lit(k).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "value")]))

    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    parts = {kind: of(k, kind) for k, kind in enumerate(KINDS)}
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return F.concat(*[F.when(needs[kind], part).otherwise(none) if kind in needs else part for kind, part in parts.items()])


def protected(span: Column) -> Column:
    """What a span is counted for: its string, and its kind."""
    kind = span["kind"].cast("string")
    return F.array(kind, F.concat_ws(":", kind, F.lower(span["value"])))


def terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERMS), F.lit(0)), F.lower))


def occurrences(held: DataFrame) -> DataFrame:
    """A row for each term of a text that holds entities: row, term, start, end, and a hash of the terms around it."""
    words = held.select("_row", matches(F.col("_text"), TERMS).alias("w")).withColumn("t", F.transform("w", lambda m: F.lower(m["value"])))
    around = lambda k: F.xxhash64(F.slice("t", F.greatest(k + 1 - NEAR, F.lit(1)), F.least(k, F.lit(NEAR)) + 1 + NEAR))
    each = F.transform("w", lambda m, k: F.struct(F.get("t", k).alias("term"), around(k).alias("around"), m["start"].alias("start"), m["end"].alias("end")))
    return words.select("_row", F.explode(each).alias("m")).select("_row", "m.*")


def likely(held: DataFrame, entities: DataFrame, docs: DataFrame, text_col: str, support: int, threshold: float) -> DataFrame:
    """(entity, term) pairs of enough documents whose disclosure reaches the threshold."""
    # an entity of fewer documents has no pair of enough
    common = written(entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support), "common")
    kept = entities.join(common.select("entity"), "entity").groupBy("_row").agg(F.collect_list("entity").alias("entities"))
    each = held.join(kept, "_row").select(F.explode("entities").alias("entity"), "_text").select("entity", F.explode(terms_of(F.col("_text"))).alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    terms = docs.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.count()
    told = pairs.join(common, "entity").join(terms, "term")
    score = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    return told.filter((F.col("n_e") < total) & (score >= threshold)).select("entity", "term")


def revealed(held: DataFrame, entities: DataFrame, docs: DataFrame, text_col: str, support: int, threshold: float) -> DataFrame:
    """(row, start, end) of the terms that reveal an entity of their text."""
    told = written(likely(held, entities, docs, text_col, support, threshold), "likely", few=True)
    found = occurrences(held).join(told.select("term").distinct(), "term").join(entities, "_row").join(told, ["entity", "term"])
    found = written(found, "told")
    several = found.groupBy("entity", "term").agg(F.countDistinct("around").alias("seen")).filter(F.col("seen") >= support)
    return found.join(several, ["entity", "term"]).select("_row", "start", "end")


def find_personal(docs: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` and spans: an array of (kind, start, end), by kind as in KINDS, then TERM, then by start."""
    text = text_of(text_col)
    found = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)], base_spans(text).alias("_spans"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    found = written(found.withColumn("_text", F.when(F.size("_spans") > 0, F.col("_text"))), "personal")
    held = found.filter("_text is not null").select("_row", "_text")
    entities = found.select("_row", F.explode(F.array_distinct(F.flatten(F.transform("_spans", protected)))).alias("entity"))
    more = F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end")
    extra = revealed(held, entities, docs, text_col, support, threshold).groupBy("_row").agg(F.sort_array(F.collect_set(more)).alias("_more"))
    plain = F.transform("_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.drop("_text").join(extra, "_row", "left")
    # words of the entities themselves are taken out with them
    apart = F.filter("_more", lambda m: ~F.exists("_spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    spans = F.when(F.col("_more").isNull(), plain).otherwise(F.concat(plain, apart))
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return joined.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)], F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with its entities replaced by their kinds and its revealing terms removed."""

    def of(s: Column) -> Column:
        return let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), lambda ends: joined(s, ends))

    def joined(s: Column, ends: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            done = F.get(ends, k)
            label = F.when(x["kind"] == TERM, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            return F.when(x["start"] < done, F.lit("")).otherwise(F.concat(F.substring(text, done + 1, x["start"] - done), label))

        last = F.greatest(F.element_at(ends, -1), F.element_at(s, -1)["end"])
        return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, last + 1, F.length(text)))

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, of))


def sanitise(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with redacted texts (a null text stays null); the columns are those of ``docs``."""
    names = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = find_personal(plain, names[text_col], tuple(plain.columns), support, threshold)
    text = F.col(names[text_col])
    found = found.withColumn("_text", F.when(text.isNotNull(), redacted(text, F.col("spans"))))
    held = {text_col: F.col("_text"), chars_col: F.coalesce(F.length("_text"), F.lit(0)).cast("bigint")}
    return found.select(*[held.get(c, F.col(n)).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])
