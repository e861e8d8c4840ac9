"""Places of ids in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.operators.lookup import in_order


def numbered(population: DataFrame, first: int | None = None) -> DataFrame:
    """ID and id_idx, its place from 0 in the order of ids; the first ids alone if wanted."""
    ids = population.select("ID").where("ID is not null").distinct()
    if first is not None:
        ids = ids.orderBy("ID").limit(first)
    return in_order(ids, [F.col("ID")], "id_idx")
