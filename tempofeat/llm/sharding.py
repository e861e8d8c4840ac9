"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their key by a range-partitioned sort.
A balanced Feistel network permutes the smallest even-bit domain that holds n;
values beyond n walk their cycle until they fall inside. Position p then means
shard p mod k and slot p div k, so counts differ by one at most, slots have no
gaps, and both the place of a row and the row at a place can be computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofeat.llm.shared import cut, unused

ROUNDS = 4


class Permutation:
    """A keyed bijection of range(n), for numpy arrays of numbers."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 0x632BE5AB) % (1 << 64)) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _network(self, x: np.ndarray, keys: list) -> np.ndarray:
        bits = np.uint64(self.half)
        left, right = x >> bits, x & self.mask
        for key in keys:
            left, right = right, left ^ self._mix(right, key)
        return (right << bits) | left  # halves swapped, so that the reversed keys undo it

    def _walk(self, x, keys: list) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._network(np.asarray(x, dtype=np.uint64), keys)
            while (beyond := out >= np.uint64(self.n)).any():
                out[beyond] = self._network(out[beyond], keys)
        return out.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def backward(self, x) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Global numbers from 0 in the given order, and the number of rows.

    Rows equal in the order are dealt by their place in the input, so that no
    group of equal rows ends in one partition; the order among them is arbitrary.
    The sorted rows are cut from their lineage by a checkpoint: partition sizes
    and numbers must come from the same run of the sort. All columns stay, but
    one of the new name is replaced.
    """
    spark, df = df.sparkSession, df.drop(name)
    tie, part, at, first = unused([*df.columns, name], "tie", "part", "at", "first")
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*order, F.col(tie)]
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(tie)
    ranged = ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = cut(ranged)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias(first))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    # one row for each shuffle partition: bounded whatever the input
    numbered = ranged.join(F.broadcast(offsets), part).withColumn(name, F.col(first) + F.col(at))
    return numbered.drop(part, at, first), total


def assign_shards(df: DataFrame, order: list[Column], shards: int, seed: int = 0) -> DataFrame:
    """df with its row_number, shard (int) and slot (long). Empty in, empty out.

    Columns of df with one of these names are replaced, but what `order` reads."""
    df = df.drop("shard", "slot")
    (spot,) = unused([*df.columns, "row_number"], "spot")
    numbered, total = number_rows(df, order)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(Permutation(total, seed).forward(x.to_numpy()))

    placed = numbered.withColumn(spot, place("row_number"))
    return placed.withColumns({"shard": (F.col(spot) % shards).cast("int"), "slot": F.floor(F.col(spot) / shards).cast("long")}).drop(spot)


def locate(row_number: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    slot, shard = divmod(int(Permutation(total, seed).forward([row_number])[0]), shards)
    return shard, slot


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The row number at a shard and slot."""
    return int(Permutation(total, seed).backward([slot * shards + shard])[0])


def document_shards(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each document by the law `rows`: counts at most one apart.

    size is the UTF-8 bytes of the text plus 8, text_crc32 that of its bytes; a
    null text has none: size 8, checksum 0. Rows are ordered by id (nulls first),
    checksum and size; rows equal in all three are interchangeable. Repeated
    rows each get a place; other columns are ignored.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = assign_shards(base, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_feistel_shards(spark, sf_dir: str) -> DataFrame:
    return document_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
