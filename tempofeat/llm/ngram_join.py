"""Near duplicates by a join on the Jaccard similarity of word n-gram sets.

1. Each text gets the 128-bit digest of its set of n-grams, and MinHash bands.
   Band and row counts are chosen for a target recall at the threshold. Rows of
   equal sets are one node.
2. Nodes are shuffled on their band hashes. In each bucket nodes are tied to the
   least one; the components of these ties hold all candidate pairs.
3. A component of one block or less is one group: each of its texts goes there
   once. Of a larger one the buckets of its bands are the groups, so that
   each text goes to as many groups as it has shared bands, however large the
   component; a pair counts in its first common bucket alone. Where the buckets
   themselves are so full that fewer texts move if the component is taken as one
   group (many near copies of one text), it is. A group beyond a block is cut
   into blocks, and every pair of blocks is a task of its own.
4. In each task pairs are verified on the full n-gram sets by an inverted index.
   Verified links are counted per node and handed on as spanning trees, never
   as pairs. Components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.components import connected
from tempofeat.llm.shared import cut, small_batches, unused

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows: of all that reach the recall at the threshold within `most`
    hashes, those with the most rows, which let the fewest dissimilar pairs pass.

    An error where none does."""
    for rows in range(16, 0, -1):
        if 1 - (1 - threshold**rows) ** (most // rows) >= recall:
            return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows
    raise ValueError(f"no bands of {most} hashes reach a recall of {recall} at {threshold}")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words: runs of other than ASCII white space.

    A text of fewer words, but not none, has one: all its words."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        return np.unique(_mixed(out))


class MinHash:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, grams: np.ndarray, part: int = 512) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        x = (grams >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(0, len(x), part):
                h = x[k : k + part, None] * self.a
                h += self.b
                h ^= h >> np.uint32(15)
                np.minimum(low, h.min(0), out=low)
            out = np.arange(self.bands, dtype=np.uint64)
            for r in range(self.rows):
                out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + low.reshape(self.bands, self.rows)[:, r])
        return out.view(np.int64)


def verified(sets: list[np.ndarray], side: np.ndarray | None, weight: np.ndarray, threshold: float, bands: np.ndarray | None = None, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the weight of those it is linked with, and the root of its tree.

    side: None to compare all with all, else only sets of different sides.
    bands: where given, a row of band hashes for each set, and only pairs whose
    first common one is `band` count."""
    m, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)
    owner = np.repeat(np.arange(m), size)
    grams = np.concatenate(sets) if m else np.zeros(0, dtype=np.uint64)
    order = np.argsort(grams, kind="stable")
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[order][1:] != grams[order][:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(grams)))
    group = np.empty(len(grams), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    holders, at = owner[order], np.concatenate([[0], np.cumsum(size)])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m):
        g = group[at[i] : at[i + 1]]
        g = g[count[g] > 1]
        if not len(g):
            continue
        n = count[g]
        where = np.repeat(begin[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(holders[where], minlength=m)
        near = np.flatnonzero((common > 0) & (common / np.maximum(size[i] + size - common, 1) >= threshold))
        near = near[near > i] if side is None else near[(near > i) & (side[near] != side[i])]
        if bands is not None:
            near = near[np.argmax(bands[near] == bands[i], axis=1) == band]
        links[i] += weight[near].sum()
        links[near] += weight[i]
        for j in near.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(m)], dtype=np.int64)


def signatures(docs: DataFrame, n: int, plan: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, digest (null without words), n_grams and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(*plan)
        for b in batches:
            digests, sizes, bands = [], [], []
            for text in b.column("text"):
                grams = ngrams(text.as_py(), n)
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                bands.append(hashed(grams) if len(grams) else [])
            arrays = [b.column("doc_id"), b.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "digest", "n_grams", "bands"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, digest binary, n_grams long, bands array<long>")


def verify(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, root and links of the nodes of each task (group, band, left, right).

    band: null where the group is a component, else that of the bucket; then
    the nodes come with the hashes of all their bands."""
    keys, names = ["group", "band", "left", "right"], ["node", "block", "copies", "bands", "text"]
    schema = "node long, root long, links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def close() -> pa.RecordBatch:
            node = np.array([r[0] for r in held], dtype=np.int64)
            side = None if task[2] == task[3] else np.array([r[1] for r in held])
            bands = None if task[1] is None else np.stack([r[3] for r in held])
            links, root = verified([r[4] for r in held], side, np.array([r[2] for r in held], dtype=np.int64), threshold, bands, task[1])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root]), pa.array(links)], ["node", "root", "links"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*keys, "node", "block", "copies")]
            for *own, node, block, copies, bands, text in zip(*columns, b.column("bands"), b.column("text"), strict=True):
                if own != task:
                    if held:
                        yield close()
                    task, held = own, []
                held.append((node, block, copies, None if own[1] is None else bands.values.to_numpy(), ngrams(text.as_py(), n)))
        if held:
            yield close()

    # nodes in order, so that the root of a tree is its least node
    return texts.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, schema)


def blocks_of(count: Column, grams: Column, block: int, block_grams: int) -> Column:
    """How many blocks a group is cut into: one holds a whole small group; of more, each is half as large, as tasks take two."""
    n = F.greatest(F.ceil(count / block), F.ceil(grams / block_grams)).cast("int")
    return F.when(n > 1, 2 * n).otherwise(1)


def groups(nodes: DataFrame, candidates: DataFrame, block: int, block_grams: int) -> DataFrame:
    """group, band, blocks of each node that has candidates: where its pairs are verified."""
    members = candidates.join(nodes.select("node", "n_grams"), "node")
    cut_in = blocks_of(F.count("*"), F.sum("n_grams"), block, block_grams)
    sizes = cut(members.groupBy("component").agg(cut_in.alias("blocks"), F.count("*").alias("n")))
    whole = members.join(sizes.where("blocks = 1"), "component").select("node", F.col("component").alias("group"), F.lit(None).cast("int").alias("band"), "blocks")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return whole
    # the nodes of large components in their buckets
    own = members.join(large.select("component"), "component").select("node", "component", "n_grams")
    banded = own.join(nodes.select("node", "bands"), "node").select("node", "component", "n_grams", F.posexplode("bands").alias("band", "group"))
    buckets = banded.groupBy("group", "band", "component").agg(cut_in.alias("blocks"), F.count("*").alias("n")).where("n > 1")
    buckets = cut(buckets)
    # texts that move: each node once per block it meets
    moved = buckets.groupBy("component").agg(F.sum(F.col("n") * F.col("blocks")).alias("by_bucket"))
    choice = cut(large.join(moved, "component").withColumn("bucketed", F.col("by_bucket") < F.col("n") * F.col("blocks")))
    full = members.join(choice.where("not bucketed").select("component", "blocks"), "component").select("node", F.col("component").alias("group"), F.lit(None).cast("int").alias("band"), "blocks")
    chosen = buckets.join(choice.where("bucketed").select("component"), "component", "left_semi").select("group", "band", "blocks")
    return whole.unionByName(full).unionByName(banded.join(chosen, ["group", "band"]).select("node", "group", "band", "blocks"))


def near_duplicates(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    block: int = 1000,
    block_grams: int = 2_000_000,
    broadcast_rows: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, node, class_id, n_links, first.

    Texts are linked if the Jaccard similarity of their sets of n words in a row
    reaches the threshold (ties count). class_id is the least doc_id of all that
    links, followed on and on, connect; n_links the number of other rows linked
    with this one, copies included; first marks the rows of the class's least
    (doc_id, text). A text without words, null too, is linked with nothing. Texts
    of fewer than n words are one n-gram. Repeated rows are copies; null ids are
    larger than all others, and a class of nulls alone has a null id. A very
    long text is compared whole; an empty table gives no rows; other columns
    are ignored. Every pair that shares a band is compared, however many; of
    pairs at the threshold `recall` come to be compared, nearer ones more.
    """
    small_batches(docs.sparkSession)
    sign = cut(signatures(docs, n, bands_for(threshold, recall), id_col, text_col))
    # one row per set; the id is fixed by the checkpoint
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = sign.where("digest is not null").groupBy("digest").agg(F.min(key).alias("key"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidates = connected(ties)

    placed = groups(nodes, candidates, block, block_grams).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tasks = placed.groupBy("node").agg(F.collect_list(F.struct("group", "band", "blocks", "block")).alias("tasks"))  # at most one for each band
    bands = F.when(F.exists("tasks", lambda t: t["band"].isNotNull()), F.col("bands")).alias("bands")
    members = cut(tasks.join(nodes.select("node", "key", "copies", "bands"), "node").select("node", "copies", "key.doc_id", "key.text_hash", bands, "tasks"))
    count, most = members.agg(F.count("*"), F.coalesce(F.max(F.size("tasks") + F.col("tasks")[0]["blocks"]), F.lit(0))).head()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    keys = members.select("node", "doc_id", "text_hash")  # three numbers a row, counted
    wanted = F.broadcast(keys) if count <= broadcast_rows else keys
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
    found = texts.join(wanted, same).select("node", "text").dropDuplicates(["node"]).join(members.select("node", "copies", "bands", "tasks"), "node")
    each = found.select("node", "copies", "bands", "text", F.explode("tasks").alias("t")).select("node", "copies", "bands", "text", "t.*")
    pair = lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right"))
    each = each.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    judged = cut(verify(each.select("*", "pair.*"), n, threshold))

    links = judged.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if most > 2:  # trees of several tasks meet in nodes they share
        links = links.drop("root").join(connected(judged.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("component", "root"), "node", "left")
    judged_nodes = nodes.select("digest", "node", "key", "copies").join(links, "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = judged_nodes.groupBy("class").agg(F.min("key").alias("least"))
    judged_nodes = judged_nodes.join(least, "class").select("digest", "class", F.col("least.doc_id").alias("class_id"), F.col("least.text_hash").alias("least_hash"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sign.select("doc_id", "text_hash", "digest").join(judged_nodes, "digest", "left")
    alone = F.col("class").isNull()
    return out.select(
        "doc_id",
        "text_hash",
        F.col("class").alias("class"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("least_hash")))).alias("first"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **how) -> DataFrame:
    """docs with one row of each class: that of the least id and text.

    Rows without words stay, each of them. Of repeated rows with the least id
    and the same text one stays."""
    rows = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **how))
    own_id, own_hash, k, h = unused(docs.columns, "dup_id", "dup_hash", "key_id", "key_hash")
    keyed = docs.withColumns({own_id: F.col(id_col), own_hash: F.xxhash64(text_col)})

    def keys(df: DataFrame) -> DataFrame:
        df = df.select(F.col("doc_id").alias(k), F.col("text_hash").alias(h)).distinct()
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    def within(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return df.join(some, F.col(own_id).eqNullSafe(F.col(k)) & (F.col(own_hash) == F.col(h)), how)

    left = within(keyed, keys(rows.where("not first")), "left_anti")
    many = rows.where("first and class is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if many.isEmpty():
        return left.drop(own_id, own_hash)
    many = keys(many)
    once = within(left, many, "left_semi").dropDuplicates([own_id, own_hash])
    return within(left, many, "left_anti").unionByName(once).drop(own_id, own_hash)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "class_id", "n_links", F.col("first").alias("is_first"))
