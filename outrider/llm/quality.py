"""Quality rules, line first.

Every line is judged on its own: it needs a sentence mark somewhere (punctuation), may not be a row
of links or cells (navigation), may not be mostly symbols or shouting, and may not be a phrase that
sites repeat (boilerplate). Failing lines go; a document that loses too many of its words' characters,
or that fails the measures of its whole text, is rejected.

All of it is column expressions over one row, so nothing is shuffled. ``let`` gives an intermediate
array a name inside an expression: as a lambda's variable it is computed once for each row, whatever
the optimizer does with the projections around it.

Cases: a null or empty text has no words and is rejected; very long texts take sorting, no more; repeated
rows are judged alike; an empty table gives an empty result; the input's other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrider.llm.common import SPACE, text_of

#: Fixed values. What ends a line is said as "nothing more", as a dollar sign also stands before a final U+0085 or U+2028 in some engines.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_MARK = r"[.!?…。！？](?:[\x20\x09-\x0D\"'»”’)\]]|(?![\s\S]))"
NAVIGATION = r"^[^|>»•·]*(?:[|»•·]|\x20>\x20)[^|>»•·]*(?:[|»•·]|\x20>\x20)"
BOILERPLATE = r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|click here|enable javascript|skip to (?:main )?content|sign up for our newsletter|back to top)\b"
#: Of a line's words, the share that may have symbols or end in two or more exclamation marks.
MARKED = 0.3
#: Of a document's word characters, the share that may go.
MOST_LOST = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words, in order; none for a blank text."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are told apart by a 64-bit hash of their words. Sorted by it, equal windows are neighbours;
    the words that the repeated windows cover are then counted from left to right.
    """

    def of(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)), again)

    def again(s: Column) -> Column:
        twin = lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(of(w)))


def line_stays(line: Column) -> Column:
    marked = F.size(F.split(line, r"(?:[#*$%&|<>]|!!+)[^\x20\x09-\x0D]*", -1)) - 1
    words = F.size(F.split(F.btrim(line, F.lit(BLANKS)), SPACE, -1))
    return line.rlike(SENTENCE_MARK) & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE) & (marked <= words * F.lit(MARKED))


def verdict(text: Column) -> Column:
    """All measures, ``clean_text``, ``lost_chars``, ``base_failed`` and ``kept`` of a text, as one struct that works each of them out once."""

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).cast("bigint").alias("n_repeat_words"))

    def cleaned(x: Column) -> Column:
        stay = lambda y: let(F.array_join(y, "\n"), lambda t: F.struct(t.alias("text"), F.length(F.array_join(words_of(t), "")).cast("bigint").alias("chars")))
        return let(F.filter(x, line_stays), lambda y: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), stay(y).alias("clean")))

    def judged(m: Column, c: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
        lost = m["word_chars"] - c["clean"]["chars"]
        symbols = (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("bigint")
        return F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
            c["clean"]["text"].alias("clean_text"), lost.alias("lost_chars"), failed.alias("base_failed"), (~failed & (lost <= m["word_chars"] * F.lit(MOST_LOST))).alias("kept"),
        )

    return let(let(words_of(text), counted), lambda m: let(let(lines_of(text), cleaned), lambda c: judged(m, c)))


def judge_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the fields of ``verdict``. It is generated, so that no filter after it works it out again."""
    return docs.select("*", F.explode(F.array(verdict(text_of(text_col)))).alias("_verdict")).select(*docs.columns, "_verdict.*")


def keep_clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines; the columns are those of ``docs``."""
    plain = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"))
    judged = judge_lines(plain, "_text").filter("kept")
    new = {text_col: F.col("clean_text"), chars_col: F.length("clean_text").cast("bigint")}
    return judged.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns])
