"""Dictionaries, with a row for each variable, column or feature, and joins with them.

A dictionary's size is checked when it is made: up to MOST rows it is kept as a
local table, which joins broadcast, or whose few keys rows are compared with
in place. A larger one is written once and
joined by a shuffle, each of its rows copied over SALTS salts, so that rows
of one very common key spread over as many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from tempofeat.storage import fixed, release, stored

MOST, SALTS = 20_000, 64
#: Up to FEW keys are compared in place: a broadcast takes some 8 MB of the driver's heap, however small the dictionary.
FEW = 200


@dataclass
class Lookup:
    frame: DataFrame
    small: bool


def lookup(df: DataFrame, most: int | None = None) -> Lookup:
    """df as a dictionary, computed once."""
    most = MOST if most is None else most
    rows = df.limit(most + 1).toArrow()
    release(df.sparkSession)
    if rows.num_rows > most:
        return Lookup(stored(df), False)
    names = df.columns
    local = df.sparkSession.createDataFrame(rows.rename_columns([f"c{i}" for i in range(len(names))]))
    return Lookup(local.toDF(*names).to(_nullable(df)), True)


def _nullable(df: DataFrame):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType, True) for f in df.schema])


def few_keys(of: Lookup, name: str) -> list | None:
    """A small dictionary's texts or whole numbers in a column, without null, if they are few."""
    if not of.small or not isinstance(of.frame.schema[name].dataType, StringType | LongType | IntegerType):
        return None
    keys = of.frame.select(name).limit(FEW + 1).collect()
    return [k for (k,) in keys if k is not None] if len(keys) <= FEW else None


def _compared(rows: DataFrame, of: Lookup, name: str, how: str) -> DataFrame | None:
    """rows with or without a dictionary's keys, as its semi or anti join; None if these are not few."""
    if rows.schema[name].dataType != of.frame.schema[name].dataType or (keys := few_keys(of, name)) is None:
        return None
    known = F.col(name).isin(keys) if keys else F.lit(False)
    return rows.where(known if how == "left_semi" else ~F.coalesce(known, F.lit(False))).select(name, *(c for c in rows.columns if c != name))


def look_up(rows: DataFrame, of: Lookup, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with a dictionary on columns of the same names.

    salts: 1 where no key has very many rows. A larger dictionary is never broadcast:
    Spark would judge its copies by the compressed size of the table that they come from."""
    if of.small:
        found = _compared(rows, of, on[0], how) if how in ("left_semi", "left_anti") and len(on) == 1 else None
        return rows.join(F.broadcast(of.frame), on, how) if found is None else found
    if salts == 1:
        return rows.join(of.frame.hint("merge"), on, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int").alias("_salt")
    copies = of.frame.select("*", F.explode(F.lit(list(range(salts)))).alias("_salt"))
    return rows.select("*", salt).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def with_ids(rows: DataFrame, population: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows joined with a population on ID, by a shuffle at any size.

    Spark would judge a stored population by the compressed size of its file, and
    broadcast a million ids through the driver, once for each join."""
    return rows.join(population.hint("merge"), "ID", how)


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place from 0 of each row in the order, whatever the size.

    A range-partitioned sort and the sizes of its partitions give the places, so
    that no single task sees all rows. Rows must differ in the order's columns."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = fixed(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), inside.alias("_at")))
    return placed(ranged, name)


def placed(ranged: DataFrame, name: str) -> DataFrame:
    """Rows with _part and _at, their partition and place there, get their place in the whole."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    # a row for each partition
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def numbered_lookup(of: Lookup, order: list[Column], name: str) -> Lookup:
    """The dictionary with the place of each row in the order."""
    if of.small:  # at most MOST rows in one task
        return Lookup(of.frame.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")), True)
    return Lookup(in_order(of.frame, order, name), False)
