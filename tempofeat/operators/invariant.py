"""Time-invariant values: the last of each entity and variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.functions.values import to_double
from tempofeat.operators.lookup import with_ids


def last_values(events: DataFrame, population: DataFrame) -> DataFrame:
    """Cells ID, col, val and num: the last non-null value, in the order of rows."""
    known = with_ids(events.where("val is not null"), population.select("ID"))
    last = known.groupBy("ID", "var").agg(F.max_by("val", "row_idx").alias("val"))
    return last.select("ID", F.concat("var", F.lit("_value")).alias("col"), "var", "val", to_double(F.col("val")).alias("num"))


def wide(cells: DataFrame, population: DataFrame) -> DataFrame:
    """One row per ID, one column per variable: for small dictionaries of variables."""
    names = [r.col for r in cells.select("col").distinct().orderBy("col").collect()]
    table = cells.groupBy("ID").pivot("col", names).agg(F.first("val"))
    return population.select("ID").join(table, "ID", "left")
