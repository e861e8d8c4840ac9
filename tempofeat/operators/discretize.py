"""Edges of quantile bins, for all columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofeat.operators.lookup import Lookup, look_up, lookup
from tempofeat.storage import stored

SHARES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def _interpolated(n: Column, share: float, low: Column, high: Column) -> Column:
    """Between the values at the two ranks next to share * (n - 1)."""
    at = F.lit(share) * (n - 1)
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def column_profile(cells: DataFrame) -> DataFrame:
    """For each column: distinct numbers, cells with numbers and with text, the mean and the edges.

    edges: distinct exact quantiles, or null with two distinct numbers or fewer.
    A histogram of each column's distinct numbers is sorted over all tasks; sums
    of counts up to each number give its ranks, and the numbers at the ranks
    next to each quantile are picked. No task holds a column's numbers."""
    counts = cells.groupBy("col", "num").agg(F.count("*").alias("c"))
    part = F.spark_partition_id().alias("part")
    hist = stored(counts.repartitionByRange("col", F.col("num").asc_nulls_first()).select("*", part))
    number = F.col("num").isNotNull()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts = hist.groupBy("col", "part").agg(
        F.count("num").alias("d"),
        count(F.when(number, F.col("c"))).alias("n"),
        count(F.when(~number, F.col("c"))).alias("t"),
        F.sum(F.col("num") * F.col("c")).alias("s"),
    )
    # a row for each column and the partitions it lies in; a window holds one column's
    parts = lookup(parts)
    column = Window.partitionBy("col")
    before = F.coalesce(F.sum("n").over(column.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = Lookup(parts.frame.select("col", "part", before.alias("before"), F.sum("n").over(column).alias("n_num"), F.sum("d").over(column).alias("numbers")), parts.small)
    ranks = look_up(hist.where(number), offsets, ["col", "part"]).where("numbers > 2")
    # a window holds what one partition has of one column
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("col", "part").orderBy("num"))
    ranks = ranks.withColumn("upto", upto)
    picks = []
    for k, p in enumerate(SHARES):
        at = F.lit(p) * (F.col("n_num") - 1)
        for name, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            picks.append(F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("num"))).alias(f"{name}{k}"))
    found = ranks.groupBy("col").agg(F.first("n_num").alias("n_num"), *picks)
    edges = F.array(*(_interpolated(F.col("n_num"), p, F.col(f"l{k}"), F.col(f"h{k}")) for k, p in enumerate(SHARES)))
    found = found.select("col", F.array_sort(F.array_distinct(edges)).alias("edges"))
    total = parts.frame.groupBy("col").agg(F.sum("d").alias("numbers"), F.sum("n").alias("n_num"), F.sum("t").alias("n_text"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    return total.join(found, "col", "left")


def predetermined(profile: DataFrame, bins: dict[str, list[float] | None]) -> DataFrame:
    """The profile with given edges in place of its own.

    Fails for columns that are not given, or given without edges though they have
    more than two numbers."""
    rows = [(c, None if e is None else [float(x) for x in e]) for c, e in bins.items()]
    given = profile.sparkSession.createDataFrame([(*r, True) for r in rows], "col string, given array<double>, known boolean")
    joined = profile.join(F.broadcast(given), "col", "left")
    bad = joined.where("known is null or (numbers > 2 and given is null)").limit(10).collect()
    if bad:
        raise ValueError("no predetermined edges for " + ", ".join(sorted(r["col"] for r in bad)))
    return joined.withColumn("edges", F.when(F.col("numbers") > 2, F.col("given"))).drop("given", "known")


def edges_by_column(profile: DataFrame) -> dict[str, list[float] | None]:
    """As a dictionary: one entry for each column."""
    return {r["col"]: r["edges"] for r in profile.select("col", "edges").toLocalIterator()}
