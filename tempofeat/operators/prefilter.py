"""What leaves before anything is inferred: other entities, times out of range, rare variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.config import Settings
from tempofeat.functions.values import is_numeric
from tempofeat.operators.lookup import Lookup, look_up, lookup, with_ids


def in_population(events: DataFrame, population: DataFrame) -> DataFrame:
    """Rows whose ID is in the population."""
    return with_ids(events, population.select("ID"))


def in_time(events: DataFrame, until: float) -> DataFrame:
    """Rows without time, or with 0 <= t < until."""
    return events.where(F.col("t").isNull() | ((F.col("t") >= 0) & (F.col("t") < F.lit(float(until)))))


def duplicated(events: DataFrame, overridden: list[str] = ()) -> DataFrame:
    """(ID, t, var) that stand more than once, with their number of rows and
    whether any value is a number; variables that are meant to be text are left out.

    Times that are missing count as equal."""
    rows = events.where(~F.col("var").isin(list(overridden))) if overridden else events
    groups = rows.groupBy("ID", "t", "var").agg(F.count("*").alias("n"), F.coalesce(F.max(is_numeric(F.col("val"))), F.lit(False)).alias("any_numeric"))
    return groups.where("n > 1")


def text_variables(value_types: dict[str, str]) -> list[str]:
    return [v for v, kind in value_types.items() if "hierarchical" in kind.lower() or "categorical" in kind.lower()]


def require_consistent(events: DataFrame, settings: Settings) -> None:
    """Fails if an entity has several numbers for a variable at one time."""
    bad = duplicated(events, text_variables(settings.value_types)).where("any_numeric").limit(5).collect()
    if bad:
        shown = "; ".join(f"ID={r.ID}, t={r.t}, {r['var']} ({r.n} rows)" for r in bad)
        raise ValueError(f"inconsistent numeric recordings, several at one time: {shown}")


def variable_counts(events: DataFrame, population: DataFrame) -> DataFrame:
    """Rows for each ID of the population and variable (those without rows left out)."""
    return in_population(events, population).groupBy("ID", "var").agg(F.count("*").alias("n"))


def occurrence(events: DataFrame, entities: int) -> DataFrame:
    """Share of all entities that have a variable at least once."""
    return events.groupBy("var").agg((F.count_distinct("ID") / F.lit(entities)).alias("share"))


def drop_rare(events: DataFrame, entities: int, theta_1: float) -> DataFrame:
    """Rows of variables that more than a share theta_1 of the entities have."""
    kept = occurrence(events, entities).where(F.col("share") > F.lit(float(theta_1))).select("var")
    return look_up(events, lookup(kept), ["var"], "left_semi")


def checked(rows: DataFrame, entities: int, settings: Settings) -> Lookup:
    """The variables that are not rare; fails where `require_consistent` would.

    One pass counts an entity's rows at one time, and from these the entities of
    each variable."""
    numbers = F.count_if(is_numeric(F.col("val"))) > 0
    text = F.col("var").isin(text_variables(settings.value_types)) if settings.value_types else F.lit(False)
    groups = rows.groupBy("ID", "t", "var").agg(((F.count("*") > 1) & numbers).alias("clash"))
    ids = groups.groupBy("var", "ID").agg(F.max(F.col("clash") & ~text).alias("clash"))
    shares = lookup(ids.groupBy("var").agg((F.count("ID") / F.lit(entities)).alias("share"), F.max("clash").alias("clash")))
    if not shares.frame.where("clash").isEmpty():
        require_consistent(rows, settings)
    kept = shares.frame.where(F.col("share") > F.lit(float(settings.theta_1))).select("var")
    return Lookup(kept, shares.small)


def prefilter(events: DataFrame, population: DataFrame, entities: int, settings: Settings) -> DataFrame:
    rows = in_time(in_population(events, population), settings.until)
    return look_up(rows, checked(rows, entities, settings), ["var"], "left_semi")
