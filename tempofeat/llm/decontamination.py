"""Benchmark decontamination by suffix arrays over shards of the training texts.

Batches of documents up to some megabytes of text are a shard. Its words become numbers of the benchmark's
own vocabulary; words outside it, and runs too short for any window, can be in
no match and are left out, without loss. A suffix array over the rest is built
by prefix doubling, and every benchmark suffix is found in it by binary search:
the range of equal suffixes gives all verbatim occurrences with their places.
Matches that go on along one diagonal join to the longest match.

The benchmark is broadcast in blocks of at most `block` words (or one item), one
at a time: with more than one, the documents are gone over once per block, and
what was found is written in between, so that neither the driver nor a worker
ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.shared import cut, small_batches, stored

# A-Z to a-z, and every other byte that is not 0-9, a-z or part of a non-ASCII character to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts in the order of the suffixes' first `depth` tokens (0 ends a run)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
        k *= 2
    return np.argsort(rank, kind="stable")


class Block:
    """Windows of some benchmark items, ready for the search."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        patterns: dict[tuple, list] = {}
        for i, (_, item) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item]
            w = min(width, len(ids))
            for at in range(len(ids) - w + 1 if w else 0):
                patterns.setdefault(tuple(ids[at : at + w]), []).append((i, at))
        self.depth = max(map(len, patterns), default=1)
        self.shortest = min(map(len, patterns), default=1)
        self.sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        self.tokens = np.zeros((len(patterns), self.depth), dtype=np.int64)
        for row, p in enumerate(patterns):
            self.tokens[row, : len(p)] = p
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in patterns.values()])]).astype(np.int64)
        self.places = np.array([x for y in patterns.values() for x in y], dtype=np.int64).reshape(-1, 2)

    def bounds(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of the suffix array that begins with it."""
        padded = np.concatenate([text, np.zeros(self.depth, dtype=text.dtype)])
        columns, rows = np.arange(self.depth), np.arange(len(self.tokens))
        real = columns < self.sizes[:, None]

        def search(beyond: bool) -> np.ndarray:
            lo, hi = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(order))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                differ = (padded[order[np.minimum(mid, len(order) - 1)][:, None] + columns] - self.tokens) * real
                first = differ[rows, np.argmax(differ != 0, axis=1)]
                go = open_ & ((first <= 0) if beyond else (first < 0))
                lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            return lo

        return search(False), search(True)

    def search(self, shard: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """document, word, window size, item and item word of every occurrence."""
        sizes = np.array([len(x) for x in shard], dtype=np.int64)
        get = self.vocabulary.get
        text = np.fromiter((get(w, 0) for x in shard for w in (*x, b"")), dtype=np.int64, count=int(sizes.sum()) + len(shard))
        # runs of known words, each with the 0 after it
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (text > 0).view(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.shortest
        spans = (end - begin + 1)[long]
        if not len(spans) or not len(self.tokens):
            return (np.zeros(0, dtype=np.int64),) * 5
        origin = np.repeat(begin[long] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        kept = text[origin]
        order = suffix_array(kept, self.depth)
        lo, hi = self.bounds(kept, order)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        at = origin[order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
        each = np.diff(self.starts)[window]  # one row for each place of the window in the benchmark
        place = np.repeat(self.starts[window] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        window, at = np.repeat(window, each), np.repeat(at, each)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        doc = np.searchsorted(first, at, side="right") - 1
        return doc, at - first[doc], self.sizes[window], self.places[place, 0], self.places[place, 1]


def longest(doc: np.ndarray, word: np.ndarray, size: np.ndarray, item: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Words of the longest verbatim match of each of n documents."""
    out = np.zeros(n, dtype=np.int64)
    if len(doc):
        order = np.lexsort((word, word - at, item, doc))
        d, w, s, i, slope = doc[order], word[order], size[order], item[order], (word - at)[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (slope[1:] != slope[:-1]) | (w[1:] != w[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:], [len(d)]]) - 1
        np.maximum.at(out, d[begin], w[last] - w[begin] + s[last])
    return out


def _blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str, block: int) -> Iterator[Block]:
    """Tables of the benchmark, none over `block` words or one item; at least one, maybe empty."""
    items, held = [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        item = words(text)
        if items and held + len(item) > block:
            yield Block(items, width)
            items, held = [], 0
        items.append((name, item))
        held += len(item)
    yield Block(items, width)


def _searched(texts: pa.Array, block: Block, before: list | None = None) -> Iterator[tuple[int, int, np.ndarray, list, int]]:
    """For each text of a shard: words, hit words, spans, items and the longest match.

    before: the spans, items and longest match that other blocks gave."""
    shard = [words(x.as_py()) for x in texts]
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in shard])]).astype(np.int64)
    cover, items, most = np.zeros(first[-1] + 1, dtype=np.int64), [set() for _ in shard], np.zeros(len(shard), dtype=np.int64)
    for d, (spans, own, longest_) in enumerate(before or ()):
        items[d].update(own)
        most[d] = longest_
        for begin, end in spans:
            cover[first[d] + begin] += 1
            cover[first[d] + end] -= 1
    doc, word, size, item, at = block.search(shard)
    np.add.at(cover, first[doc] + word, 1)
    np.add.at(cover, first[doc] + word + size, -1)
    for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
        items[d].add(block.names[i])
    most = np.maximum(most, longest(doc, word, size, item, at, len(shard)))
    hit = np.cumsum(cover) > 0
    any_hit = np.logical_or.reduceat(hit, first[:-1]) if len(shard) else hit
    for d, x in enumerate(shard):
        own = hit[first[d] : first[d] + len(x)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) if any_hit[d] else np.zeros(0, dtype=np.int64)
        yield len(x), int(own.sum()), edges.reshape(-1, 2), sorted(i for i in items[d] if i is not None), int(most[d])


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, gathered to about `size` bytes each."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


MATCHES = "doc_id {}, text string, n_words long, n_hit long, items array<string>, longest long, spans array<array<long>>"


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 10,
    block: int = 1_000_000,
    shard: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For every row of docs what it shares verbatim with benchmark items.

    Words: runs of digits, letters and non-ASCII characters after A-Z became
    a-z. An item's windows are its runs of `width` words, or all its words if
    it has fewer; a null or wordless item has none. n_hit counts the words of
    the document inside any occurrence of a window, spans has their [begin, end)
    ranges, items the ids (as sorted strings, once each; null ids are not
    listed, though their windows count), longest the longest verbatim match.
    Null and empty texts have no words; a very long text is a shard of its own.
    Repeated rows stay; other columns are ignored; an empty benchmark hits
    nothing, and no documents give no rows.
    """
    small_batches(docs.sparkSession)
    context, kind = docs.sparkSession.sparkContext, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tables = _blocks(benchmark, width, item_col, item_text_col, block)
    now = next(tables)
    while True:
        after = next(tables, None)
        table = context.broadcast(now)  # a block: at most `block` words or one item

        def run(batches: Iterator[pa.RecordBatch], table=table, last=after is None) -> Iterator[pa.RecordBatch]:
            for b in _shards(batches, shard):
                before = None
                if "spans" in b.schema.names:
                    before = list(zip(*(b.column(c).to_pylist() for c in ("spans", "items", "longest")), strict=True))
                n, hit, spans, items, most = list(zip(*_searched(b.column(1), table.value, before), strict=True)) or [()] * 5
                text = pa.nulls(len(b), pa.string()) if last else b.column(1)
                arrays = [b.column(0), text, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(most, pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "n_hit", "items", "longest", "spans"])

        rows = rows.mapInArrow(run, MATCHES.format(kind))
        if after is None:
            return rows.drop("text")
        rows, now = cut(rows), after
        table.unpersist()


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, block: int = 1_000_000, shard: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark.

    Null, empty and wordless texts hold none and stay, as does everything
    beside an empty benchmark; of repeated rows all stay or none."""
    small_batches(docs.sparkSession)
    context, rows = docs.sparkSession.sparkContext, docs
    tables = _blocks(benchmark, width, item_col, item_text_col, block)
    now = next(tables)
    while True:
        after = next(tables, None)
        table = context.broadcast(now)  # a block: at most `block` words or one item

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for b in _shards(batches, shard):
                yield b.filter(pa.array([hit == 0 for _, hit, *_ in _searched(b.column(text_col), table.value)], pa.bool_()))

        rows = rows.mapInArrow(run, docs.schema)
        if after is None:
            return rows
        rows, now = stored(rows), after
        table.unpersist()


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def op4_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s[0], s[1])), " ").alias("hit_spans"),
    )
