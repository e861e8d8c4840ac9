"""Column functions on values, times and quantile bins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value in text files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_DIGITS = r"\d+(_\d+)*"
#: Text that reads as a floating-point number, with single underscores between digits.
NUMERIC = rf"^\s*[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def missing(c: Column) -> Column:
    """NULL where the text is one of the tokens for a missing value."""
    return F.when(~c.isin(NA_TOKENS), c)


def is_numeric(c: Column) -> Column:
    """Whether the text is a number; NULL for NULL."""
    return c.rlike(NUMERIC)


def to_double(c: Column) -> Column:
    """The number in the text; NULL for other text, and for not-a-number."""
    number = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "_", "").try_cast("double")
    return F.when(is_numeric(c) & ~F.isnan(number), number)


def time_bin(t: Column, dt: float, bins: int | None = None) -> Column:
    """k with k*dt <= t < (k+1)*dt, or NULL outside of the bins; every k if their number is not given.

    The quotient is corrected at the edges, where division may round across."""
    k = F.floor(t / F.lit(float(dt)))
    step = F.lit(float(dt))
    k = F.when(t >= (k + 1) * step, k + 1).when(t < k * step, k - 1).otherwise(k)
    return (k if bins is None else F.when((k >= 0) & (k < bins), k)).cast("int")


def bin_edges(dt: float, bins: int) -> list[float]:
    return [k * dt for k in range(bins + 1)]


def time_label(k: int, dt: float) -> str:
    return f"[{float(k * dt)}, {float((k + 1) * dt)})"


def interval(x: Column, edges: Column, most: int | None = None) -> Column:
    """Number from 1 of the right-closed interval between edges that holds x.

    The first one holds its left edge too; NULL outside. most: the greatest
    number of edges, if known; a few are counted in compiled code."""
    if most is not None and most <= 16:
        below = sum((F.when(F.get(edges, F.lit(k)) < x, 1).otherwise(0) for k in range(most)), F.lit(0))
    else:
        below = F.size(F.filter(edges, lambda e: e < x))
    k = F.when(x == F.get(edges, F.lit(0)), 1).otherwise(below)
    return F.when((k >= 1) & (k < F.size(edges)), k)


def exceeded(x: Column, edges: Column) -> Column:
    """Positions from 1 of the edges, but the last, that x exceeds."""
    inner = F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0)))
    return F.filter(F.transform(inner, lambda e, i: F.when(x > e, i + 1)), lambda i: i.isNotNull())


def number_text(x: Column) -> Column:
    """A double as text: 60.0, not 6.0E1."""
    whole = F.concat(x.try_cast("decimal(20,0)").cast("string"), F.lit(".0"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), whole).otherwise(x.cast("string"))


def _rounded(x: float, digits: int) -> float:
    if not np.isfinite(x) or x == 0:
        return x
    fraction, whole = np.modf(x)
    if whole == 0:
        digits += -int(math.floor(math.log10(abs(fraction)))) - 1
    return float(np.around(x, digits))


def interval_labels(edges: list[float], precision: int = 3) -> list[str]:
    """Names of the right-closed intervals: as few decimals from `precision` on as
    keep the edges apart, and the first edge lowered by the last decimal."""
    for p in range(precision, 20):
        breaks = [_rounded(e, p) for e in edges]
        if len(set(breaks)) == len(edges):
            break
    else:
        p, breaks = precision, list(edges)
    breaks[0] = _rounded(breaks[0] - 10**-p, 12)
    return [f"({float(a)}, {float(b)}]" for a, b in zip(breaks, breaks[1:], strict=False)]
