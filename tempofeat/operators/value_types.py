"""Types of variables, inferred from all their values, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.functions.values import is_numeric
from tempofeat.operators.lookup import Lookup, look_up, lookup
from tempofeat.storage import stored


def detect(events: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """var, value_type (None, Numeric, Numeric + Categorical, Categorical, or the
    override) and numeric: whether any value reads as a number."""
    counted = events.groupBy("var").agg(F.count("val").alias("n"), F.count_if(is_numeric(F.col("val"))).alias("numbers"))
    inferred = F.when(F.col("n") == 0, "None").when(F.col("numbers") == F.col("n"), "Numeric").when(F.col("numbers") > 0, "Numeric + Categorical").otherwise("Categorical")
    for name, kind in (overrides or {}).items():
        inferred = F.when(F.col("var") == name, kind).otherwise(inferred)
    return counted.select("var", inferred.alias("value_type"), (F.col("numbers") > 0).alias("numeric"))


def forced_variables(overrides: dict[str, str]) -> list[str]:
    return [v for v, k in overrides.items() if k == "Categorical" or "hierarchical" in k.lower()]


def force_categorical(events: DataFrame, overrides: dict[str, str], prefix_nulls: bool = False, types: Lookup | None = None) -> DataFrame:
    """Values of variables overridden as Categorical, and of hierarchical ones, as text
    that no longer reads as a number: prefixed with _ if any of the values does.

    types: what `detect` found in these events, if known."""
    names = forced_variables(overrides)
    if not names:
        return events
    own = types.frame if types else detect(events.where(F.col("var").isin(names)))
    # at most one row for each override
    numeric = [r["var"] for r in own.where("numeric").where(F.col("var").isin(names)).select("var").collect()]
    if not numeric:
        return events
    value = F.concat(F.lit("_"), F.coalesce("val", F.lit("nan")) if prefix_nulls else F.col("val"))
    return events.withColumn("val", F.when(F.col("var").isin(numeric), value).otherwise(F.col("val")))


def premap_duplicates(events: DataFrame, types: Lookup | DataFrame) -> DataFrame:
    """Rows of text variables that share ID, t and variable become variables of their
    own, {var}:{value} with value 1; the variable's other rows stay.

    The duplicates are looked up, by ID, time and variable: there are as many as
    entities, or more, and few rows of each. Only rows of text variables move."""
    types = types if isinstance(types, Lookup) else lookup(types)
    # a small dictionary is filtered in the driver, where lower() would load the title case of all characters, 100 MB
    text = types.frame.where(~F.col("value_type").rlike("(?i)numeric|none")).select("var")
    text = Lookup(text, types.small)
    # a missing time is a time of its own
    rows = look_up(events, text, ["var"], "left_semi").withColumns({"t_null": F.col("t").isNull(), "t_key": F.coalesce("t", F.lit(0.0))})
    on = ["ID", "t_null", "t_key", "var"]
    twice = rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on, F.lit(True).alias("twice"))
    rows = look_up(rows, lookup(stored(twice)), on, "left", salts=1)
    dup = F.col("twice").isNotNull()
    named = F.concat(F.col("var"), F.lit(":"), F.coalesce("val", F.lit("nan")))
    out = rows.withColumns({"val": F.when(dup, F.lit("1")).otherwise(F.col("val")), "var": F.when(dup, named).otherwise(F.col("var"))})
    others = look_up(events, text, ["var"], "left_anti")
    return out.select(*events.columns).unionByName(others.select(*events.columns))


def timeless(events: DataFrame) -> DataFrame:
    """Variables that have any row without time: all their rows are time-invariant."""
    return events.where("t is null").select("var").distinct()


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of time-invariant and of time-stamped variables."""
    names = lookup(timeless(events))
    return tuple(look_up(events, names, ["var"], how).select(*events.columns) for how in ("left_semi", "left_anti"))
