"""Binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds, in days, and labels of the lead-time bins.
LEAD_BINS = [(0, "same_day"), (2, "1_2"), (7, "3_7"), (14, "8_14"), (30, "15_30"), (60, "31_60")]
LAST_LEAD_BIN = "61_plus"
LEAD_EDGES = [-0.1, 0, 2, 7, 14, 30, 60, 180]


def lead_time_bin(days: Column) -> Column:
    """One of seven labels; NULL lead times, like the longest, are ``61_plus``."""
    out = F.when(days <= LEAD_BINS[0][0], LEAD_BINS[0][1])
    for top, label in LEAD_BINS[1:]:
        out = out.when(days <= top, label)
    return out.otherwise(LAST_LEAD_BIN)


def cut(c: Column, edges: Sequence[float]) -> Column:
    """The number of the right-closed bin between neighbouring edges, the lowest edge included; NULL outside."""
    out = F.when(c.isNull() | (c < edges[0]) | (c > edges[-1]), None)
    for k, top in enumerate(edges[1:]):
        out = out.when(c <= top, k)
    return out.cast("int")


def cut_labels(edges: Sequence[float]) -> list[str]:
    """Labels of ``cut``'s bins; the first shows that its lower edge is included."""
    low = [edges[0] - 0.001, *edges[1:-1]]
    return [f"({a:g}, {b:g}]" for a, b in zip(low, edges[1:], strict=True)]


def cut_label(c: Column, edges: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in cut_labels(edges)]), cut(c, edges))


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """1 for the lowest quantile bin on, right-closed, after equal edges are merged; NULL where nothing is left to cut."""
    merged = sorted(set(edges))
    return cut(c, merged) + 1 if len(merged) > 1 else F.lit(None).cast("int")


def equal_width_bin(p: Column, bins: int = 10, closed_top: bool = True) -> Column:
    """The left-closed bin of [0, 1] by comparison with the edges k / bins, as products of doubles can fall short.

    With ``closed_top`` the value 1 belongs to the last bin; without, to a bin of its own.
    """
    edges = [k * (1.0 / bins) for k in range(1, bins)] + ([] if closed_top else [1.0])
    out = F.lit(0)
    for e in edges:
        out = out + F.when(p >= F.lit(e), 1).otherwise(0)
    return F.when(p.isNotNull(), out)


def small_to_other(c: Column, n: Column, least: int, other: str = "OTHER_SMALL") -> Column:
    """The value, or a common one where its group is smaller than ``least``."""
    return F.when(n < least, other).otherwise(c)
