"""Writing features and what belongs to them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tempofeat.storage import write_text


def write_json(spark: SparkSession, value, path: str) -> None:
    """A JSON file beside the tables, on whatever file system they are."""
    write_text(spark, path, json.dumps(value))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """A folder of CSV files with headers."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all)


def write_features(name: str, features: DataFrame, cells: DataFrame, out: str, aliases: DataFrame | None = None, bins: dict | None = None) -> None:
    """{name}: cells (Parquet, row by row), names in order, and aliases or edges as JSON."""
    spark = cells.sparkSession
    cells.sortWithinPartitions("row_id", "feature_id").write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    features.write.mode("overwrite").parquet(f"{out}/{name}.features.parquet")
    names = [r.name for r in features.orderBy("feature_id").select("name").toLocalIterator()]
    write_json(spark, names, f"{out}/{name}.feature_names.json")
    if aliases is not None:
        found: dict[str, list[str]] = {}
        for r in aliases.orderBy("kept_id", "dropped_id").toLocalIterator():
            found.setdefault(r.kept, []).append(r.alias)
        write_json(spark, found, f"{out}/{name}.feature_aliases.json")
    if bins is not None:
        write_json(spark, bins, f"{out}/{name}.discretization.json")
