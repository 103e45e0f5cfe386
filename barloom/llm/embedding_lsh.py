"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashes, join_sized, numbered
from .components import components, spanning_forest

SIMILARITY = 0.9
#: The share of pairs at exactly the threshold that some table must catch; pairs above it are likelier.
RECALL = 0.97
#: Mean rows of a bucket that bits are chosen for, and the most that one numpy product takes a side.
BUCKET = 64
BLOCK = 2048
SEED = 11
#: Rows that a unit of comparisons takes, blocks aside.
UNIT_ROWS = 65_536
_FOUND = "a long, b long, links long"
_MET = "node long, t int, code long, i int, j int, side int, unit long"


def tables_for(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets stay near BUCKET rows as the input grows; tables follow from the recall."""
    bits = int(np.clip(round(math.log2(max(nodes, 1) / BUCKET)), 2, 40)) if nodes > BUCKET else 2
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_differ(bits: int, tables: int, similarity: float = SIMILARITY) -> int:
    """Sign bits in which vectors at the threshold or above differ at most: six standard deviations over the mean."""
    n, p = bits * tables, math.acos(similarity) / math.pi
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def _sign(bits: int, tables: int):
    """The code of each table, and all sign bits, packed."""

    def sign(rows):
        planes: dict[int, np.ndarray] = {}
        for batch in rows:
            vectors = batch.column("vector").to_pylist()
            size = np.array([len(v) for v in vectors])
            codes = np.zeros((len(vectors), tables), np.int64)
            signs = np.zeros((len(vectors), tables * bits), bool)
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.random.default_rng((SEED, int(dim))).normal(size=(int(dim) // 8, tables * bits))
                own = np.flatnonzero(size == dim)
                x = np.frombuffer(b"".join(vectors[i] for i in own), np.float64).reshape(len(own), -1)
                signs[own] = x @ planes[dim] > 0
                codes[own] = _codes(signs[own], bits) * 31 + dim
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel())), pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())], names=["node", "codes", "signs"])

    return sign


def _codes(signs: np.ndarray, bits: int) -> np.ndarray:
    return (signs.reshape(len(signs), -1, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)


def _signs(table: pa.Table, own: np.ndarray, bits: int, tables: int) -> np.ndarray:
    data = b"".join(table.column("signs").take(pa.array(own)).to_pylist())
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(len(own), -1), axis=1)[:, : bits * tables] > 0


def _buckets(table: pa.Table):
    """(rows, left, right, whole) of each pair of blocks in a unit; ``whole``: the block meets itself."""
    t, code, i, j, side, node = (table.column(c).to_numpy() for c in ("t", "code", "i", "j", "side", "node"))
    order = np.lexsort((side, node, j, i, code, t))
    keys = np.stack([t, code, i, j])[:, order]
    cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    for own in np.split(order, cuts[1:]):
        whole = i[own[0]] == j[own[0]]
        left = np.arange(len(own)) if whole else np.flatnonzero(side[own] == 0)
        right = left if whole else np.flatnonzero(side[own] == 1)
        if len(own) > 1 and len(left) and len(right):
            yield own, left, right, whole


def _fresh(near: np.ndarray, signs: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The pairs that no earlier table catches: a pair counts in the first one."""
    codes, fresh = _codes(signs, bits), near.copy()
    for k in range(table):
        fresh &= codes[left, k][:, None] != codes[right, k][None, :]
    return fresh


def _meet(bits: int, tables: int, differ: int):
    """The rows of a unit that have a partner in their bucket whose sign bits are near theirs and that no earlier table finds."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t, keep = table.column("t").to_numpy(), np.zeros(table.num_rows, bool)
        for own, left, right, whole in _buckets(table):
            signs = _signs(table, own, bits, tables)
            x = signs.astype(np.float32) * 2 - 1
            near = x[left] @ x[right].T >= bits * tables - 2 * differ
            if whole:
                np.fill_diagonal(near, False)
            if near.any() and (fresh := _fresh(near, signs, left, right, int(t[own[0]]), bits)).any():
                keep[own[left[fresh.any(axis=1)]]] = True
                keep[own[right[fresh.any(axis=0)]]] = True
        return table.select(["node", "t", "code", "i", "j", "side", "unit"]).filter(pa.array(keep))

    return meet


def _link(similarity: float, bits: int, tables: int):
    """Links inside the buckets of a unit: a row (node, itself, links) for each node that has some, and forest edges."""

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t, node, weight = (table.column(c).to_numpy() for c in ("t", "node", "size"))
        out_a, out_b, out_n = ([np.zeros(0, np.int64)] for _ in range(3))
        for own, left, right, whole in _buckets(table):
            x = np.frombuffer(b"".join(table.column("vector").take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), -1)
            near = x[left] @ x[right].T >= similarity
            if whole:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            fresh = _fresh(near, _signs(table, own, bits, tables), left, right, int(t[own[0]]), bits)
            for rows, links in ((left, fresh @ weight[own[right]]), *(() if whole else ((right, weight[own[left]] @ fresh),))):
                hit = links > 0
                out_a.append(node[own[rows[hit]]])
                out_b.append(node[own[rows[hit]]])
                out_n.append(links[hit])
            if not fresh.any():
                continue
            label = spanning_forest(near, left, right, len(own))  # not all pairs
            moved = np.flatnonzero(label != np.arange(len(own)))
            out_a.append(node[own[moved]])
            out_b.append(node[own[label[moved]]])
            out_n.append(np.zeros(len(moved), np.int64))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b, out_n)], names=["a", "b", "links"])

    return link


def near_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows of equal vectors are one node of their count, so copies cost nothing. Nodes that
    share a code in some table meet by their sign bits first; the vectors themselves travel
    only to the buckets where a partner is near by these, and are compared by their exact
    cosine in double precision. A bucket above ``block`` rows is dealt as pairs of blocks,
    so no task holds it whole; counting all links of a group of near copies is quadratic in
    its distinct vectors, in numpy, without a row for a pair.

    Vectors that are null, empty, all zero or hold null or non-finite components link with
    nothing, nor do vectors of different length. Repeated vec_ids count as separate rows;
    a null vec_id is larger than all ids and kept only in a component of its own kind. A tie
    at exactly the threshold is a link. Other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    doubles = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0), F.lit(False))
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, doubles).alias("v"))
    h1, h2 = hashes("v")
    good = own.where("v is not null").select("vec_id", "v", h1.alias("h1"), h2.alias("h2"))
    distinct = good.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))

    def pack(batches):
        for batch in batches:
            parts = []
            for v in batch.column("v"):
                x = v.values.to_numpy()
                x = x / np.abs(x).max()  # no overflow in the norm
                parts.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "size")), pa.array(parts, pa.binary())], names=["h1", "h2", "size", "vector"])

    nodes = numbered(distinct.mapInArrow(pack, "h1 long, h2 long, size long, vector binary"), "node")
    total = nodes.count()
    bits, tables = tables_for(total, similarity, recall)
    signed = cut(nodes.select("node", "vector").mapInArrow(_sign(bits, tables), "node long, codes array<long>, signs binary"))
    codes = signed.select("node", F.posexplode("codes").alias("t", "code"))
    buckets = cut(codes.groupBy("t", "code").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")))
    dealt = buckets.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    met = join_sized(signed.select("node", "signs", F.posexplode("codes").alias("t", "code")), buckets, ["t", "code"], "rows", total * tables)
    met = met.withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block k meets every block: as the left side of those above it, as the right side of those below
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"), F.when(F.col("k") <= o, 0).otherwise(1).alias("side")))
    met = met.select("node", "signs", "t", "code", F.explode(pair).alias("p")).select("node", "signs", "t", "code", "p.*")
    met = met.withColumn("unit", F.pmod(F.xxhash64("t", "code", "i", "j"), F.lit(max(16, dealt // UNIT_ROWS))))
    alike = met.groupBy("unit").applyInArrow(_meet(bits, tables, most_differ(bits, tables, similarity)), _MET)
    whole = nodes.select("node", "size", "vector").join(signed.select("node", "signs"), "node")
    found = cut(alike.join(whole, "node").groupBy("unit").applyInArrow(_link(similarity, bits, tables), _FOUND))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("a <> b").select("a", "b"))
    known = nodes.select("h1", "h2", "node", "size").join(links, "node", "left").join(parts, "node", "left")
    known = cut(known.select("h1", "h2", "size", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    joined = cut(join_sized(good.select("vec_id", "h1", "h2"), known, ["h1", "h2"], "size", good.count()).select("vec_id", "component", "n_links"))
    least = cut(joined.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    out = join_sized(joined, least, ["component"], "members", joined.count()).select("vec_id", "n_links", "component_id")
    alone = own.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
