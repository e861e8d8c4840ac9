"""Time-stamped values by entity, time bin and variable.

All entities at once: events fall into bins and aggregate there; values of
frequent numeric variables are carried forward through the bins. Cells are
long: ID, bin, col, grp and ord (the place of the column), val and num.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempofeat.config import Settings
from tempofeat.functions.statistics import statistic
from tempofeat.functions.values import time_bin, to_double
from tempofeat.operators.lookup import Lookup, few_keys, look_up, lookup, with_ids

#: Places of the groups of columns.
PLAIN, MASK, DELTA, VALUE, STATS = range(5)


def frequent_numeric(events: DataFrame, types: Lookup | DataFrame, population: DataFrame, entities: int, settings: Settings) -> DataFrame:
    """Numeric variables with theta_freq recordings per entity and bin on average."""
    counts = with_ids(events, population.select("ID")).groupBy("var").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") / F.lit(entities) >= F.lit(float(settings.theta_freq * settings.L)))
    types = types.frame if isinstance(types, Lookup) else types
    return often.join(types.where(F.col("value_type") == "Numeric").select("var"), "var", "left_semi").select("var")


def binned(events: DataFrame, population: DataFrame, settings: Settings) -> DataFrame:
    """Events of the population in their bins; those outside of all bins have no part."""
    rows = with_ids(events, population.select("ID")).withColumn("bin", time_bin(F.col("t"), settings.dt, settings.L))
    return rows.where("bin is not null and val is not null")


def latest(rows: DataFrame) -> DataFrame:
    """Cells {var}_value: the last non-null value in a bin, without imputation."""
    last = rows.groupBy("ID", "bin", "var").agg(F.max_by("val", F.struct("t", "row_idx")).alias("val"))
    return last.select("ID", "bin", "var", F.concat("var", F.lit("_value")).alias("col"), F.lit(PLAIN).alias("grp"), F.lit(0).alias("ord"), "val", to_double(F.col("val")).alias("num"))


def observed(rows: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """For each bin with events: the last number, and the statistics."""
    numbers = rows.withColumn("v", to_double(F.col("val"))).where("v is not null")
    order = F.struct("t", "row_idx")
    aggregates = [statistic(s).of(F.col("v"), order).alias(f"s_{i}") for i, s in enumerate(stats)]
    return numbers.groupBy("ID", "bin", "var").agg(F.max_by("v", order).alias("last"), *aggregates)


def filled(rows: DataFrame, population: DataFrame, often: Lookup, settings: Settings) -> DataFrame:
    """mask, delta, value and statistics in every bin of the frequent variables.

    A bin without events carries the last value before it forward, as if that
    were its only event; delta counts the bins since then. Before the first
    event there is nothing. No grid is shuffled: each bin with events is
    followed by the bins up to the next one, made in place, and the bins before
    the first follow a start that every entity and variable has."""
    stats, bins = settings.stats, settings.L
    seen = observed(look_up(rows, often, ["var"], "left_semi"), stats)
    # a row for each entity and frequent variable: the result has L of them
    names = few_keys(often, "var")
    if names is not None:
        pairs = population.select("ID", F.explode(F.lit(names).cast("array<string>")).alias("var"))
    else:
        pairs = look_up(population.select("ID", F.explode(F.lit([0])).alias("one")), Lookup(often.frame.select("var", F.lit(0).alias("one")), often.small), ["one"])
    starts = pairs.select("ID", F.lit(-1).alias("bin"), "var", *(F.lit(None).cast(t).alias(c) for c, t in seen.dtypes[3:]))
    by_bin = Window.partitionBy("ID", "var").orderBy("bin")
    seen = seen.unionByName(starts).withColumn("next", F.coalesce(F.lead("bin").over(by_bin), F.lit(bins)))
    seen = seen.where("next > greatest(bin, 0)")
    each = seen.withColumn("b", F.explode(F.sequence(F.greatest("bin", F.lit(0)), F.col("next") - 1)))
    known = F.col("bin") >= 0
    mask, later = F.col("b") == F.col("bin"), F.col("next") < bins  # later: the entity has the variable in some bin
    values = []
    for i, name in enumerate(stats):
        s = statistic(name)
        values.append(F.when(mask, F.col(f"s_{i}")).when(known, s.carried(F.col("last"))).when(later, F.lit(s.empty).cast("double")).cast("double").alias(f"s_{i}"))
    return each.select("ID", F.col("b").alias("bin"), "var", mask.alias("mask"), F.when(known, F.col("b") - F.col("bin")).otherwise(0).alias("delta"), F.when(known, F.col("last")).alias("value"), *values)


def filled_cells(table: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """`filled` as cells; masks only where set, and nulls left out."""

    def cell(grp: int, ord_: int, suffix: str, num, text) -> F:
        return F.struct(F.lit(grp).alias("grp"), F.lit(ord_).alias("ord"), F.concat("var", F.lit(f"_{suffix}")).alias("col"), num.cast("double").alias("num"), text.alias("val"))

    none = F.lit(None).cast("string")
    parts = [
        cell(MASK, 0, "mask", F.when(F.col("mask"), 1), none),
        cell(DELTA, 0, "delta_time", F.col("delta"), F.col("delta").cast("string")),
        cell(VALUE, 0, "value", F.col("value"), none),
        *(cell(STATS, i, s, F.col(f"s_{i}"), none) for i, s in enumerate(stats)),
    ]
    rows = table.select("ID", "bin", "var", F.explode(F.array(*parts)).alias("c")).where("c.num is not null")
    return rows.select("ID", "bin", "var", "c.col", "c.grp", "c.ord", "c.val", "c.num")


def series(events: DataFrame, types: Lookup | DataFrame, population: DataFrame, entities: int, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Cells of all time-stamped variables, and the filled table of the frequent ones."""
    often = lookup(frequent_numeric(events, types, population, entities, settings))
    rows = binned(events, population, settings)
    if often.frame.isEmpty():
        return latest(rows), None
    table = filled(rows, population, often, settings)
    plain = latest(look_up(rows, often, ["var"], "left_anti"))
    return plain.unionByName(filled_cells(table, settings.stats)), table


def imputation_counts(table: DataFrame) -> DataFrame:
    """For each frequent variable the bins that carry a value, and those that have none yet."""
    return table.groupBy("var").agg(F.count_if(~F.col("mask") & (F.col("delta") > 0)).alias("imputed"), F.count_if(~F.col("mask") & (F.col("delta") == 0)).alias("not_imputed"))


def missing_entries(cells: DataFrame, rows: int) -> DataFrame:
    """For each column that has any value the rows of the time series without and with one."""
    return cells.groupBy("col").agg((F.lit(rows).cast("long") - F.count("*")).alias("missing"), F.count("*").alias("present"))
