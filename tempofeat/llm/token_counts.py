"""Token counts by a two-tier lookup of pre-token lengths, with no pre-token shuffle.

A first pass over all texts keeps in each partition a Misra-Gries summary of its
pre-tokens (bounded, mergeable); whole summaries are merged in a tree. The most
frequent pre-tokens get their lengths in tokens and are broadcast as one compact
table, bounded by `table` entries of `longest` characters. The second pass looks
every pre-token up there; misses are encoded through a bounded worker cache.
The counts do not depend on the table.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.bpe import Tokenizer
from tempofeat.llm.shared import cut, small_batches


def shrink(counts: Counter, size: int) -> Counter:
    """The Misra-Gries reduction to at most `size` entries."""
    if len(counts) <= size:
        return counts
    floor = sorted(counts.values(), reverse=True)[size]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def frequent(docs: DataFrame, tokenizer: str, size: int, longest: int, fan: int = 32) -> list[str]:
    """The most frequent pre-tokens of the one column of docs, over all its rows."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, counts = Tokenizer(tokenizer).splitter(), Counter()
        for b in batches:
            for text in b.column(0):
                counts.update((split(text.as_py() or "") if split else None) or ())
                if len(counts) > 12 * size:
                    counts = shrink(counts, 4 * size)
        counts = Counter({k: v for k, v in counts.items() if len(k) <= longest})
        blob = pickle.dumps(dict(shrink(counts, size)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        total = Counter()
        for blob in rows.column("blob").to_pylist():
            total.update(pickle.loads(blob))
            total = shrink(total, 2 * size)
        part = rows.column("part")[0].as_py() // fan
        return pa.table({"part": pa.array([part], pa.int64()), "blob": pa.array([pickle.dumps(dict(shrink(total, size)))], pa.binary())})

    sums = cut(docs.mapInArrow(summary, "part long, blob binary"))  # a bounded row for each partition
    n = sums.count()
    while n > fan:
        sums, n = sums.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, "part long, blob binary"), -(-n // fan)
    total = Counter()
    for row in sums.collect():  # at most `fan` bounded summaries
        total.update(pickle.loads(row.blob))
        total = shrink(total, 2 * size)
    return [k for k, _ in total.most_common(size)]


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    table: int = 16384,
    longest: int = 32,
    cache: int = 1 << 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row.

    A null text counts as empty: no bytes, and the tokens of the empty text.
    Strings of special tokens inside texts count as the library takes them by
    default. Repeated rows and null ids stay; other columns are ignored; an empty
    table gives no rows. A very long text is counted whole.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    local = Tokenizer(tokenizer)
    known = frequent(texts.select("text"), tokenizer, table, longest) if local.engine else []
    lengths = docs.sparkSession.sparkContext.broadcast({k: local.piece_length(k) for k in known})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(tokenizer)
        split, first = tok.splitter(), lengths.value.get
        kept = lru_cache(cache)(tok.piece_length) if split else None

        def miss(piece: str) -> int:
            return kept(piece) if len(piece) <= longest else tok.piece_length(piece)

        def number(text: str) -> int:
            pieces = split(text) if split else None
            if pieces is None:
                return len(tok.library(text))
            found = list(map(first, pieces))
            n = sum(filter(None, found))
            return n + sum(miss(p) for p, x in zip(pieces, found, strict=True) if x is None) if None in found else n

        for b in batches:
            n = pa.array([number(text.as_py()) for text in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(texts.dtypes)["doc_id"]
    out = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
