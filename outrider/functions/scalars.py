"""Scalar column functions, all built in and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(name: str) -> str:
    """A column or table name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def normalise_name(name: str) -> str:
    """A header as a column name: trimmed, lower-cased, spaces and hyphens as underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def unmarked(c: Column, mark: str = "?") -> Column:
    """NULL where the text is the mark for a missing value."""
    return F.nullif(c, F.lit(mark))


def integer_of_text(c: Column, kind: str = "int") -> Column:
    """Text as an integer: decimals round half away from zero, anything else is NULL. Plain integers keep all digits."""
    return F.coalesce(c.try_cast(kind), F.round(c.try_cast("double")).try_cast(kind))


def integer_of_double(c: Column, kind: str = "int") -> Column:
    """A double as an integer, halves to the even neighbour."""
    return F.bround(c).cast(kind)


def number_of(c: Column) -> Column:
    """Text as a double; anything else is NULL."""
    return c.try_cast("double")


def timestamp_of(c: Column) -> Column:
    return c.try_cast("timestamp")


def date_of(first: Column, second: Column) -> Column:
    """The first that is a date, else the second's."""
    return F.coalesce(first.try_cast("date"), second.try_cast("date"))


def whole_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def day_of_week(d: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(d) - 1).cast("bigint")


def month_of(d: Column) -> Column:
    return F.month(d).cast("bigint")


def hour_of(ts: Column) -> Column:
    return F.hour(ts).cast("bigint")


def days_after(start: str, days: Column) -> Column:
    """A timestamp some whole days after a date."""
    return F.date_add(F.lit(start).cast("date"), days.cast("int")).cast("timestamp")


def clipped(c: Column, low: float, high: float) -> Column:
    """Between low and high; a NULL becomes high, as the smaller of NULL and high is high."""
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def log1p_of(c: Column) -> Column:
    """ln(1 + x), with negatives and NULL as 0."""
    return F.log(1 + F.greatest(F.lit(0), c))


def says_yes(c: Column) -> Column:
    """1 for yes in any case, else 0; 0 for NULL."""
    return F.coalesce((F.lower(c) == "yes").cast("int"), F.lit(0))


def flag(condition: Column) -> Column:
    """1 or 0; 0 for NULL."""
    return F.when(condition, 1).otherwise(0)


def probability(c: Column, eps: float = 1e-15) -> Column:
    """Within [eps, 1 - eps], so that logarithms are finite; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), c)))


def logit(p: Column, eps: float = 1e-15) -> Column:
    q = probability(p, eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def portable_hash(key: Column, seed: str = "") -> Column:
    """A number below 2**32 that other engines compute alike: the first 8 hex digits of the MD5."""
    text = F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit_interval(key: Column, seed: str = "") -> Column:
    """In [0, 1), by ``portable_hash``."""
    return (portable_hash(key, seed) % 1_000_000) / F.lit(1_000_000.0)
