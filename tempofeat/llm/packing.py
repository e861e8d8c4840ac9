"""Packing of tokenised documents into sequences of a fixed capacity.

Every input partition packs its own documents, so nothing is shuffled: tokens
are gathered into blocks of bounded size, and in each block pieces in
descending order go to the sequence of the lowest cost (linear plus quadratic
attention cost of its pieces) that still has room for them. If none has, the
piece is cut at the largest room left. What is over goes to the next block, so
that only the last sequence of a partition is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.bpe import Tokenizer
from tempofeat.llm.shared import small_batches

SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Packer:
    """Fills sequences; `add` and `close` give rows of finished blocks."""

    def __init__(self, capacity: int, linear: float, quadratic: float, block: int):
        self.capacity, self.linear, self.quadratic, self.block = capacity, linear, quadratic, block
        self.pool: list[tuple] = []
        self.held = self.made = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.pool.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        return self._pack(self.held // self.capacity) if self.held >= self.block * self.capacity else []

    def close(self) -> list[tuple]:
        return self._pack(-(-self.held // self.capacity))

    def cost(self, n):
        return self.linear * n + self.quadratic * n * n

    def _pack(self, n: int) -> list[tuple]:
        if not n:
            return []
        room, cost, rows, order = np.full(n, self.capacity), np.zeros(n), [], count()
        heap = []
        for doc_id, start, total, ids in self.pool:
            for at in range(0, len(ids), self.capacity):
                part = ids[at : at + self.capacity]
                heap.append((-len(part), next(order), doc_id, start + at, total, part))
        heapq.heapify(heap)
        self.pool = []
        while heap:
            _, _, doc_id, start, total, ids = heapq.heappop(heap)
            fits = np.flatnonzero(room >= len(ids))
            if len(fits):
                to = fits[np.argmin(cost[fits])]
            else:
                to = int(np.argmax(room))
                if not room[to]:
                    self.pool.append((doc_id, start, total, ids))
                    continue
                rest = ids[room[to] :]
                heapq.heappush(heap, (-len(rest), next(order), doc_id, start + int(room[to]), total, rest))
                ids = ids[: room[to]]
            own = float(self.cost(len(ids)))
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.made + int(to), self.capacity - int(room[to]), own))
            room[to] -= len(ids)
            cost[to] += own
        self.made += n
        self.held = sum(len(x[3]) for x in self.pool)
        return rows


def pack(
    docs: DataFrame,
    *,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence.

    Each document becomes its token ids and then `end_id`; a null or empty text
    is just `end_id`. Pieces partition the ids of every row, repeated rows and
    null ids included; ids keep their type, other columns are ignored.
    sequence_id is unique over the whole result: the partition in the upper
    bits, so it depends on how the input is split. A very long text fills
    sequences of its own and shares its last one. An empty table gives no rows.
    `block` sequences at a time are held in memory, and one text's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = Tokenizer(tokenizer).ids, Packer(capacity, linear, quadratic, block)
        high = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [None] + [pa.int64()] * 6 + [pa.float64()]

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            columns[5] = [high | x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            types[0] = b.schema[0].type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                if rows := packer.add(doc_id, ids):
                    yield batch(rows)
        if rows := packer.close():
            yield batch(rows)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(dict(rows.dtypes)["doc_id"]))


def op8_cost_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
