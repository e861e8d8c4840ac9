"""Reading events, populations and lookup tables.

Events have the columns ID, t (double; null: time-invariant), var, val (text)
and row_idx, which keeps the order of the rows of the source: the last value of
an entity, and ties in time, depend on it.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofeat.functions.values import missing, to_double
from tempofeat.storage import read_text

COLUMNS = {"ID": "ID", "t": "t", "var_name": "variable_name", "var_value": "variable_value"}


def events_from(df: DataFrame, names: dict[str, str] = COLUMNS, order: list[Column] | None = None) -> DataFrame:
    """Events from any table with the four columns.

    order: columns that fix the order of rows; else that of the source's files."""
    order = order or [F.monotonically_increasing_id()]
    text = missing(F.col(names["var_value"]).cast("string"))
    kind = dict(df.dtypes)[names["t"]]
    time = to_double(missing(F.col(names["t"]))) if kind == "string" else F.nanvl(F.col(names["t"]).cast("double"), F.lit(None).cast("double"))
    return df.select(
        F.col(names["ID"]).alias("ID"),
        time.alias("t"),
        F.col(names["var_name"]).cast("string").alias("var"),
        text.alias("val"),
        (F.struct(*order) if len(order) > 1 else order[0]).alias("row_idx"),
    )


def with_common_ids(events: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ids of one type, decided once: text ids become numbers if all of both
    tables are whole ones; else, if the types differ, all are text."""
    kinds = [dict(df.dtypes)["ID"] for df in (events, population)]
    if "string" not in kinds:
        return events, population
    texts = [df for df, kind in zip((events, population), kinds, strict=True) if kind == "string"]
    whole = lambda df: df.where(F.col("ID").isNotNull() & F.col("ID").try_cast("bigint").isNull()).isEmpty()
    kind = "bigint" if all(whole(df) for df in texts) else "string"
    return tuple(df.withColumn("ID", F.col("ID").cast(kind)) if dict(df.dtypes)["ID"] != kind else df for df in (events, population))


def read_events(spark: SparkSession, path: str, names: dict[str, str] = COLUMNS) -> DataFrame:
    """Events of a .csv, .parquet, .orc, .json, .p or .pickle file, or of a catalog table."""
    place = [F.col("_file"), F.col("_block"), F.monotonically_increasing_id()]
    files = lambda df: df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    suffix = Path(path).suffix
    if suffix == ".csv":
        return events_from(files(spark.read.csv(path, header=True)), names, place)
    if suffix in (".parquet", ".orc", ".json"):
        return events_from(files(getattr(spark.read, suffix[1:])(path)), names, place)
    if suffix in (".p", ".pickle"):
        import pandas as pd  # a local file of the old format; trusted input only

        frame = pd.read_pickle(path)
        frame[names["var_value"]] = [None if pd.isnull(v) else str(v) for v in frame[names["var_value"]]]
        return events_from(spark.createDataFrame(frame), names)
    if suffix == "" and spark.catalog.tableExists(path):
        return events_from(spark.table(path), names)
    raise ValueError(f"cannot read events from {path!r}: neither csv, parquet, orc, json, pickle nor a table")


def read_population(spark: SparkSession, path: str, names: dict[str, str] = COLUMNS) -> DataFrame:
    """The distinct ids of a population: a .csv, .parquet, .orc, .json, .p or .pickle file, or a catalog table."""
    suffix = Path(path).suffix
    if suffix == ".csv":
        df = spark.read.csv(path, header=True)
    elif suffix in (".parquet", ".orc", ".json"):
        df = getattr(spark.read, suffix[1:])(path)
    elif suffix in (".p", ".pickle"):
        import pandas as pd  # a local file of the old format; trusted input only

        df = spark.createDataFrame(pd.read_pickle(path))
    elif suffix == "" and spark.catalog.tableExists(path):
        df = spark.table(path)
    else:
        raise ValueError(f"cannot read a population from {path!r}: neither csv, parquet, orc, json, pickle nor a table")
    return df.select(F.col(names["ID"]).alias("ID")).where("ID is not null").distinct()


def read_bins(spark: SparkSession, path: str) -> dict[str, list[float] | None]:
    """Predetermined edges by column, as `write_json` leaves them."""
    return json.loads(read_text(spark, path))


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-separated table without header: code9, code10, description."""
    return spark.read.csv(path, sep="|", schema="code9 string, code10 string, description string").select("code9", "code10")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """A hierarchy of codes: a pipe-separated table without header, of a code and
    its path, the names from the root to the code itself, joined by `/`."""
    rows = spark.read.csv(path, sep="|", schema="code string, path string")
    return rows.select("code", F.split("path", "/").alias("path"))


def read_lookups(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame] | None:
    """The lookup tables of coded hierarchies that paths names: paths9, paths10, code_map."""
    readers = {"paths9": read_paths, "paths10": read_paths, "code_map": read_code_map}
    return {name: readers[name](spark, path) for name, path in paths.items()} or None
