"""From cells of columns to features: one-hot, ordinal, or numbers with a default.

Features: feature_id, name, col, kind, level, text, default_value. Cells: row, feature_id, value,
without the zeros of a matrix; an absent cell has the feature's default_value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tempofeat.functions.values import exceeded, interval, interval_labels, number_text
from tempofeat.operators.discretize import column_profile, predetermined
from tempofeat.operators.lookup import Lookup, look_up, lookup, numbered_lookup
from tempofeat.operators.temporal import MASK
from tempofeat.storage import stored

MASKED, INTERVAL, ABOVE, TEXT, NUMBER = range(-1, 4)


def cell_text(cells: DataFrame) -> Column:
    """The raw value of a cell: its text, or its number as text."""
    return F.coalesce("val", number_text(F.col("num")))


def encode_discrete(cells: DataFrame, profile: Lookup | DataFrame, ordinal: bool) -> DataFrame:
    """Cells with kind, level (place of an interval or edge) and text of their features.

    Columns of more than two numbers: intervals, or with `ordinal` all edges that
    are exceeded, and text as it is. Others: their raw values."""
    profile = profile if isinstance(profile, Lookup) else lookup(profile)
    rows = look_up(cells, Lookup(profile.frame.select("col", "edges"), profile.small), ["col"])
    binned = F.col("edges").isNotNull() & F.col("num").isNotNull()
    text = F.when(~binned, cell_text(cells))
    if ordinal:
        levels = F.when(binned, exceeded(F.col("num"), F.col("edges"))).otherwise(F.array(F.lit(0).cast("int")))
        rows = rows.withColumn("level", F.explode(levels))
    else:
        most = profile.frame.agg(F.max(F.size("edges"))).head()[0] if profile.small else None
        rows = rows.withColumn("level", F.when(binned, interval(F.col("num"), F.col("edges"), most)).otherwise(0).cast("int")).where("level is not null")
    kind = F.when(binned, ABOVE if ordinal else INTERVAL).otherwise(TEXT)
    return rows.select(*cells.columns, kind.alias("kind"), "level", text.alias("text"), F.lit(1.0).alias("value"))


def encode_plain(cells: DataFrame, profile: Lookup | DataFrame) -> DataFrame:
    """Cells of columns as numbers, text as one-hot levels; absent numbers get the mean.

    A column with numbers and text has both; its text is named {col}_str."""
    profile = profile if isinstance(profile, Lookup) else lookup(profile)
    rows = look_up(cells, Lookup(profile.frame.select("col", F.col("n_num").alias("has_num")), profile.small), ["col"])
    number = F.col("num").isNotNull()
    return rows.select(
        *cells.columns,
        F.when(number, NUMBER).otherwise(TEXT).alias("kind"),
        F.when(~number & (F.col("has_num") > 0), 1).otherwise(0).alias("level"),  # 1: text beside numbers
        F.when(~number, F.col("val")).alias("text"),
        F.when(number, F.col("num")).otherwise(1.0).alias("value"),
    )


@F.pandas_udf(ArrayType(StringType()))
def _labels(edges: pd.Series) -> pd.Series:
    """Names of a column's intervals."""
    return edges.map(lambda e: interval_labels([float(x) for x in e]) if e is not None and len(e) > 1 else [])


@F.pandas_udf(ArrayType(StringType()))
def _steps(edges: pd.Series) -> pd.Series:
    """Names of a column's edges but the last."""
    return edges.map(lambda e: [str(float(x)) for x in e[:-1]] if e is not None else [])


def _names(features: DataFrame, profile: Lookup, discretize: bool) -> DataFrame:
    """Names of features; those of intervals and edges come from their columns' edges."""
    if not discretize:
        sep = F.when(F.col("level") == 1, "_str:").otherwise(":")
        return features.withColumn("name", F.when(F.col("kind") == NUMBER, F.col("col")).otherwise(F.concat("col", sep, "text")))
    named = profile.frame.where("edges is not null").select("col", _labels("edges").alias("labels"), _steps("edges").alias("steps"))
    rows = look_up(features, lookup(named), ["col"], "left")
    interval_name = F.concat("col", F.lit("_"), F.try_element_at("labels", "level"))
    step_name = F.concat("col", F.lit(">"), F.try_element_at("steps", "level"))
    name = F.when(F.col("kind") == INTERVAL, interval_name).when(F.col("kind") == ABOVE, step_name).otherwise(F.concat("col", F.lit("_"), "text"))
    return rows.withColumn("name", name).drop("labels", "steps")


def to_features(cells: DataFrame, keys: list[str], masks: DataFrame | None, settings, bins: dict | None) -> tuple[Lookup, DataFrame, DataFrame]:
    """features, encoded cells (keys, feature_id, value) and the profile of the columns.

    cells: keys, col, var, val, num, and for time series grp and ord, which order
    the columns; masks come first, and text split from numbers last. Within a
    column: intervals or edges ascending, then text."""
    profile = column_profile(cells)
    if settings.discretize:
        profile = lookup(predetermined(profile, bins) if bins is not None else profile)
        coded = encode_discrete(cells, profile, settings.use_ordinal_encoding)
        last = F.lit(0)
    else:
        profile = lookup(profile)
        coded = encode_plain(cells, profile)
        last = F.when((F.col("kind") == TEXT) & (F.col("level") == 1), 1).otherwise(0)
    has_place = "grp" in cells.columns
    place = [F.col("grp"), F.col("ord")] if has_place else [F.lit(0).alias("grp"), F.lit(0).alias("ord")]
    parts = [*keys, "col", "var", *place, "kind", "level", F.coalesce("text", F.lit("")).alias("text"), "value"]
    coded = coded.select(*parts)
    if masks is not None:
        coded = coded.unionByName(masks.select(*keys, "col", "var", "grp", "ord", F.lit(MASKED).alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), F.lit(1.0).alias("value")))
    coded = stored(coded)
    names = ["col", "var", "grp", "ord", "kind", "level", "text"]
    listed = coded.select(*names).distinct()
    if settings.discretize and settings.use_ordinal_encoding:
        # every edge but the last is a feature, exceeded or not
        edges = Lookup(profile.frame.where("edges is not null").select("col", F.size("edges").alias("n")), profile.small)
        every = look_up(cells.select("col", "var", *place).distinct(), edges, ["col"]).where("n > 1")
        every = every.select("col", "var", "grp", "ord", F.lit(ABOVE).alias("kind"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("level"), F.lit("").alias("text"))
        listed = listed.unionByName(every).distinct()
    listed = lookup(listed.withColumn("last", last))
    named = _names(listed.frame.where(F.col("kind") != MASKED), profile, settings.discretize)
    if masks is not None:
        named = named.unionByName(listed.frame.where(F.col("kind") == MASKED).withColumn("name", F.col("col")))
    means = Lookup(profile.frame.select("col", "mean"), profile.small)
    named = look_up(named, means, ["col"], "left")
    named = named.withColumn("default_value", F.when(F.col("kind") == NUMBER, F.col("mean")).otherwise(0.0)).drop("mean")
    first = F.when(F.col("grp") == MASK, 0).otherwise(1) if has_place else F.lit(1)
    order = [first, *map(F.col, ("last", "grp", "var", "ord", "col", "kind", "level", "text"))]
    features = numbered_lookup(Lookup(named, listed.small), order, "feature_id")
    features = lookup(features.frame)
    on = ["col", "kind", "level", "text"]
    ids = Lookup(features.frame.select(*on, "feature_id"), features.small)
    out = look_up(coded.select(*keys, *on, "value"), ids, on).select(*keys, "feature_id", "value")
    shown = features.frame.withColumn("text", F.when(F.col("kind") == TEXT, F.col("text")))
    return Lookup(shown.select("feature_id", "name", "col", "kind", "level", "text", "default_value"), features.small), out, profile.frame
