"""Statistics of the events in a time bin, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Statistic:
    """of: aggregates values v, ordered by `order` (time and place).
    carried: what a bin without events has, given the last value before it.
    absent: what an entity that has the variable in no bin gets."""

    of: Callable[[Column, Column], Column]
    carried: Callable[[Column], Column] = lambda v: v
    empty: float | None = None


def _skew(v: Column, _: Column) -> Column:
    n = F.count(v)
    return F.when(n > 2, F.when(F.var_pop(v) == 0, F.lit(0.0)).otherwise(F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)))


def _none(v: Column) -> Column:
    return F.lit(None).cast("double")


def _one(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit(1.0))


#: sum, prod and count of an empty bin before the first event are that of no numbers.
STATISTICS: dict[str, Statistic] = {
    "min": Statistic(lambda v, o: F.min(v)),
    "max": Statistic(lambda v, o: F.max(v)),
    "mean": Statistic(lambda v, o: F.avg(v)),
    "median": Statistic(lambda v, o: F.median(v)),
    "std": Statistic(lambda v, o: F.when(F.count(v) > 1, F.stddev_samp(v)), _none),
    "var": Statistic(lambda v, o: F.when(F.count(v) > 1, F.var_samp(v)), _none),
    "sem": Statistic(lambda v, o: F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v))), _none),
    "sum": Statistic(lambda v, o: F.coalesce(F.sum(v), F.lit(0.0)), empty=0.0),
    "prod": Statistic(lambda v, o: F.coalesce(F.product(v), F.lit(1.0)), empty=1.0),
    "count": Statistic(lambda v, o: F.count(v).cast("double"), _one, empty=0.0),
    "nunique": Statistic(lambda v, o: F.count_distinct(v).cast("double"), _one, empty=0.0),
    "first": Statistic(lambda v, o: F.min_by(v, F.when(v.isNotNull(), o))),
    "last": Statistic(lambda v, o: F.max_by(v, F.when(v.isNotNull(), o))),
    "skew": Statistic(_skew, _none),
    "slope": Statistic(lambda v, o: F.regr_slope(v, o["t"]), _none),
}


def register(name: str, statistic: Statistic) -> None:
    """Makes a statistic available by name."""
    STATISTICS[name] = statistic


def statistic(name: str) -> Statistic:
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name!r}; there are {', '.join(STATISTICS)}")
    return STATISTICS[name]
