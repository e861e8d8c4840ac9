"""The most recent value of each entity, bin and variable, kept up to date on a stream.

Shares, types, edges and correlations need all data, so a stream is only ever
transformed with what a batch run has found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.config import Settings
from tempofeat.functions.values import interval, time_bin, to_double


def latest_on_stream(events: DataFrame, settings: Settings) -> DataFrame:
    """ID, bin, var, val, num of a streaming frame of events, for output mode update."""
    rows = events.withColumn("bin", time_bin(F.col("t"), settings.dt, settings.L)).where("bin is not null and val is not null")
    last = rows.groupBy("ID", "bin", "var").agg(F.max_by("val", F.struct("t", "row_idx")).alias("val"))
    return last.withColumn("num", to_double(F.col("val")))


def with_frozen_bins(cells: DataFrame, edges: dict[str, list[float] | None]) -> DataFrame:
    """The interval of each number by a batch run's edges of {var}_value; null without."""
    rows = [(c.removesuffix("_value"), e) for c, e in edges.items() if e and c.endswith("_value")]
    known = cells.sparkSession.createDataFrame(rows, "var string, edges array<double>")
    out = cells.join(F.broadcast(known), "var", "left")  # a row for each column of the batch run
    return out.withColumn("interval", F.when(F.col("edges").isNotNull(), interval(F.col("num"), F.col("edges")))).drop("edges")
