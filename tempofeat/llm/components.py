"""Connected components of a graph of long ids: by union-find where a task can hold it, else by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.llm.shared import cut


#: At most so many nodes can be hubs.
HUBS = 100_000
#: Up to so many edges meet in one task, which holds some 100 bytes for each.
LOCAL = 1_000_000


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def contracted(batches: Iterator[pa.RecordBatch], most: int, roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars: each node with the least it is connected with.

    More than `most` edges are contracted first, and handed on where that leaves
    more than half. roots: with a row for the least nodes too."""
    held, n = [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        some = slice(None) if roots else nodes != least
        return nodes[some], least[some]

    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        n += b.num_rows
        if n > most:
            held = [stars()]
            n = len(held[0][0])
            if n > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], ["u", "v"])


def _stars(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """The edges of each task as stars."""
    return edges.select("u", "v").mapInArrow(lambda batches: contracted(batches, most, roots), "u long, v long")


def meet(edges: DataFrame, least: DataFrame, degree: int, hubs: bool) -> DataFrame:
    """The edges with m of their u. No task gets more than `degree` edges of one u.

    At most HUBS nodes have more (`degree` is at least their share of all edge
    ends): these are broadcast, so that their edges stay where they are."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    known = F.broadcast(least.where(F.col("d") > degree).select("u", "m"))
    few = edges.join(known.drop("m"), "u", "left_anti").join(least.where(F.col("d") <= degree).select("u", "m"), "u")
    return few.unionByName(edges.join(known, "u"))


def connected(edges: DataFrame, rounds: int | None = None, local: int = LOCAL) -> DataFrame:
    """node and component (the least node in it) of every node of edges (u, v).

    Loops and repeated edges do no harm; no edges give no rows. Each task first
    contracts its own edges to stars. Up to `local` of these one task makes the
    components of; of more, or if `rounds` is given, every round joins each node's neighbours to the least of them, first all larger ones,
    then all smaller ones, until nothing changes; the edges then are stars. No
    group is gathered anywhere: minima combine on the map side, and the hubs,
    nodes with more than a HUBS-th of all edge ends, meet their edges by a
    broadcast. Each round's edges are checkpointed. If `rounds` is given and
    they run out before that, an error is raised.
    """
    stars = cut(_stars(edges.where("u <> v"), LOCAL))
    if rounds is None and stars.count() <= local:
        return cut(_stars(stars.coalesce(1), max(local, LOCAL), roots=True)).toDF("node", "component")
    star = cut(stars.distinct())
    seen = None
    for done in count():
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.count("*").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        state = ends.agg(F.coalesce(F.sum("d"), F.lit(0)), F.sum("h"), F.max("d")).head()
        if tuple(state) == seen or not state[0]:
            break
        if done == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        seen = tuple(state)
        degree = max(100, state[0] // HUBS)
        hubs = state[2] > degree
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        large = meet(both.where("v > u"), least, degree, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        moved = meet(large, least, degree, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
