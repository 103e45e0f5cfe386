"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts at a time: 16 bytes each.
PART_EDGES = 500_000


def spanning_forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """Least node that each of ``nodes`` reaches by the links near[i, j] between left[i] and right[j]."""
    label = np.arange(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(near, label[right], nodes).min(axis=1, initial=nodes))
        np.minimum.at(new, right, np.where(near, label[left][:, None], nodes).min(axis=0, initial=nodes))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the least one that it reaches inside the partition."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a, b); component is its least node.

    Partitions of bounded size are first contracted on their own. Each round then shuffles
    the edges by node and cuts lineage; no node's neighbours are gathered in one row, and
    a hub is a skewed join that Spark splits. Self-links and
    null ends are ignored; without edges the result is empty.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = -(-edges.count() // PART_EDGES)
    edges = cut(edges.coalesce(max(1, parts)).mapInArrow(contract, "a long, b long"))
    state = _state(edges)
    if state[0]:
        for _ in range(rounds):
            edges = cut(_small_star(_large_star(edges)))
            state, before = _state(edges), state
            if state == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
