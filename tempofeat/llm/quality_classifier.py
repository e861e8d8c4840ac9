"""A supervised subword classifier of document quality.

Words, pairs of neighbouring words and the character n-grams of the text, hashed
into buckets, have learned vectors; a document is the average of its features' vectors, and a softmax over
two classes judges it. Vectors and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents. Scoring
works on the code points of whole Arrow batches: with two classes each bucket's vector
acts through its inner product with the difference of the class vectors, so a
document's logit is the mean of one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.shared import small_batches

GRAMS = (3, 4)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts in `data`, and each one's text.

    data: code points; text i is data[starts[i]:starts[i + 1]]. Features: n-grams
    of characters of each size, spaces included but not across texts, whole
    words, and pairs of neighbouring words, in either order. A word is a run of other than ASCII
    white space."""
    n, shift = len(data), np.uint64(64 - int(buckets).bit_length() + 1)
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found, owner = [], []
    x = data.astype(np.uint64) + np.uint64(1)  # capitals count as letters of their own: shouting is a sign
    with np.errstate(over="ignore"):
        for g in GRAMS:
            if n < g:
                continue
            h = np.full(n - g + 1, g, dtype=np.uint64)
            for k in range(g):
                h = h * np.uint64(1000003) + x[k : n - g + 1 + k]
            same = text_of[: n - g + 1] == text_of[g - 1 :]
            found.append(((h[same] * _ODD) >> shift).astype(np.int64))
            owner.append(text_of[: n - g + 1][same])
        if n:
            # word hashes: differences of running sums of letters weighted by place within the word
            letter = (data != 32) & ((data < 9) | (data > 13))
            edge = np.ones(n, dtype=bool)
            edge[1:] = ~letter[:-1] | (text_of[1:] != text_of[:-1])
            begin = np.flatnonzero(letter & edge)
            if len(begin):
                place = np.arange(n) - np.maximum.accumulate(np.where(edge, np.arange(n), 0))
                weight = (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
                weight ^= weight >> np.uint64(31)
                own = np.where(letter, x * x * weight + x, np.uint64(0))
                h = np.add.reduceat(own, begin)
                found.append(((h * _ODD) >> shift).astype(np.int64))
                owner.append(text_of[begin])
                near = text_of[begin[1:]] == text_of[begin[:-1]]
                pair = h[:-1] ^ h[1:]  # in either order; of a word and itself one feature, whatever the word
                found.append(((pair[near] * _ODD) >> shift).astype(np.int64))
                owner.append(text_of[begin[1:][near]])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owner)


def slices(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about `most` bytes (or one longer text): first, code points, starts."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and at[-1] > 0 else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        own, starts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        if len(own) and own.max() >= 128:
            starts = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[starts]
            own = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        yield i, own, starts
        i = j


@dataclass
class Model:
    """What scoring needs: one number per bucket and an offset."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, data, starts in slices(texts):
            bucket, owner = features(data, starts, len(self.weight))
            n = len(starts) - 1
            total = np.bincount(owner, weights=self.weight[bucket], minlength=n)
            logit = self.bias + total / np.maximum(np.bincount(owner, minlength=n), 1)
            out[first : first + n] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, vector_rate: float, batch: int, seed: int) -> Model:
    """Stochastic gradient descent on averaged vectors and a softmax.

    rows: distinct buckets and how many of each document's features are in
    each. Classes weigh alike. With rows of one class, or none, the score is constant."""
    ones = float(labels.sum())
    if not len(labels) or ones in (0.0, float(len(labels))):
        share = (ones + 1) / (len(labels) + 2)
        return Model(np.zeros(buckets, dtype=np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    weigh = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones))).astype(np.float32)
    onehot = np.eye(2, dtype=np.float32)[labels]
    steps, done = epochs * -(-len(labels) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            slow = 1 - done / steps
            step, move = rate * slow, vector_rate * slow
            done += 1
            part = [(b, (n / max(n.sum(), 1)).astype(np.float32)) for b, n in (rows[i] for i in own)]
            mean = np.stack([shares @ vectors[b] for b, shares in part])
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            off = (p / p.sum(1, keepdims=True) - onehot[own]) * weigh[own, None] / len(own)
            back = off @ soft.T
            soft -= step * (mean.T @ off)
            bias -= step * off.sum(0)
            for (b, shares), g in zip(part, back, strict=True):
                vectors[b] -= move * len(own) * shares[:, None] * g  # buckets of a row are distinct
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """The documents of at most `most` labelled ids outside the fold: text and label.

    Ids come in the order of a hash, so that the sample is the same for the
    same rows; of an id's labels the highest counts, null ids have none. Ids are
    chosen before texts are read: no text is shuffled. An id that stands on
    several rows gives them all; `one_each` leaves one."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = own.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    # `most` rows of two numbers: a proven bound
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id, the least; copies of an id fall away on the map side, before the driver.

    In parts of their own, so that the driver's JVM holds some of them at a time."""
    rest = [c for c in rows.columns if c != "doc_id"]
    once = rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")
    return once.repartition(64, "doc_id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    folds: int = 5,
    fold: int = 0,
    sample: int = 4000,
    buckets: int = 1 << 15,
    dim: int = 8,
    epochs: int = 8,
    rate: float = 0.2,
    vector_rate: float = 300.0,
    batch: int = 16,
    seed: int = 7,
) -> Model:
    """A model from at most `sample` labelled documents outside the fold, one for each id.

    docs: doc_id and text; other columns are ignored, null and empty texts have
    no features, labels without a document have no part. Their features are counted on the executors over whole texts; only buckets
    and counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for _, data, starts in slices(b.column("text")):
                bucket, owner = features(data, starts, buckets)
                bucket = bucket[np.argsort(owner, kind="stable")]
                for part in np.split(bucket, np.cumsum(np.bincount(owner, minlength=len(starts) - 1))[:-1]):
                    own, n = np.unique(part, return_counts=True)
                    ids.append(own.astype("<u4" if buckets > 1 << 16 else "<u2").tobytes())
                    counts.append(n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), b.column("_label")], ["doc_id", "ids", "counts", "label"])

    rows = one_each(labelled_sample(docs, labels, label, folds, fold, sample).mapInArrow(run, "doc_id string, ids binary, counts binary, label int")).toArrow().sort_by("doc_id")
    made = [(np.frombuffer(a.as_buffer(), "<u4" if buckets > 1 << 16 else "<u2"), c.as_buffer()) for a, c in zip(rows["ids"], rows["counts"], strict=True)]
    made = [(a, np.frombuffer(c, f"<u{len(c) // max(len(a), 1)}" if len(a) else "<u1")) for a, c in made]
    return train(made, np.array(rows["label"].to_pylist(), dtype=np.int64), buckets, dim, epochs, rate, vector_rate, batch, seed)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in [0, 1]; a null or empty text gets the model's offset.

    A very long text counts whole. A column of that name is replaced; repeated
    rows score alike; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per bucket, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(text_col)))], [*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def kept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that score the threshold or more (ties stay)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_subword_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
