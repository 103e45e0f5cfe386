"""MinHash near-dedup over weighted sets of word shingles: BagMinHash, bands, exact overlap.

Weights are counts, so they are discretised at the integers. The weight axis is
cut into the intervals (0, 1], (1, 2], (2, 4], (4, 8], ...; each shingle has one
Poisson process over each interval up to its count, at the interval's length as
rate. A point falls on a place of the axis, which counts if it lies within the
weight, and on one of the registers, which keep their earliest point. Two
documents agree in a register with probability sum(min) / sum(max), the weighted
Jaccard similarity. Processes end once they are past a document's latest register.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import batches, cut, hashes, join_sized, keyed, numbered, unused
from .components import components, spanning_forest

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 4 registers: a pair at similarity 0.8 shares no band with probability 3e-6.
BANDS = 24
ROWS = 4
#: Documents a side that one comparison of blocks takes, of texts and of sketches.
BLOCK = 256
SKETCH_BLOCK = 1024
#: Of 96 registers a pair at similarity 0.8 shares under 0.58 with probability 4e-7, far rarer than no band.
ESTIMATE = 0.58
#: Rows that a unit of comparisons takes, of texts and of sketches, blocks aside.
UNIT_ROWS = 2000
SKETCH_UNIT_ROWS = 50_000
_STEP_BYTES = 2 << 20
_TICKS = float(2**36)
_NEVER = np.int64(2**62)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, lower-cased, and where each text's begin.

    A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    data, offsets = ts.flat(pc.utf8_lower(texts))
    starts, ends, first = ts.words(data, offsets)
    words = ts.span_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - SHINGLE_WORDS + 1, 1), 0)
    out = np.zeros(int(counts.sum()), np.uint64)
    begin = np.append(0, np.cumsum(counts))
    full = n >= SHINGLE_WORDS
    out[ts.ranges(begin[:-1][full], counts[full])] = ts.sequence_hashes(words, SHINGLE_WORDS)[ts.ranges(first[:-1][full], counts[full])]
    for k in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n == k)
        out[begin[short]] = ts.run_hashes(words, first[short], k)
    return out, begin


def signatures(hashes: np.ndarray, begin: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """(texts, registers) of earliest points; a text without shingles keeps ``2**62`` everywhere."""
    texts = len(begin) - 1
    text = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(begin))
    key = np.sort((text << np.uint64(48)) | (hashes >> np.uint64(16)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    # one process for each interval that the weight reaches
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    of = np.repeat(np.arange(len(key)), levels)
    level = ts.ranges(np.zeros(len(key), np.int64), levels)
    owner = (key >> np.uint64(48)).astype(np.int64)[of]
    low = np.where(level == 0, 0, np.int64(1) << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1)
    room = np.minimum(weight[of] - low, rate)  # places of the interval within the weight
    seed = ts.mix((key & np.uint64((1 << 48) - 1))[of] * np.uint64(64) + level.astype(np.uint64))
    time = np.zeros(len(of), np.int64)
    point = np.zeros(len(of), np.uint64)
    earliest = np.full(texts * registers, _NEVER, np.int64)
    while len(of):
        block = int(np.clip(100_000 // len(of), 1, 64))
        index = point[:, None] + np.arange(1, block + 1, dtype=np.uint64)
        chance = ts.mix(seed[:, None] + index * np.uint64(0x9E3779B97F4A7C15))
        place = ts.mix(chance + np.uint64(0xD1B54A32D192ED03))
        # whole ticks: sums do not depend on how points are blocked
        gap = (-np.log(((chance >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * (_TICKS / rate[:, None])).astype(np.int64)
        at = time[:, None] + np.cumsum(gap, axis=1)
        inside = ((place >> np.uint64(32)) % rate[:, None].astype(np.uint64)).astype(np.int64) < room[:, None]
        slot = owner[:, None] * registers + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot[inside], at[inside])
        latest = earliest.reshape(texts, registers).max(axis=1)
        on = at[:, -1] <= latest[owner]
        owner, rate, room, seed, time, point = owner[on], rate[on], room[on], seed[on], at[on, -1], point[on] + np.uint64(block)
        of = of[on]
    return earliest.reshape(texts, registers)


def band_keys(earliest: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    texts = len(earliest)
    part = earliest.reshape(texts, -1, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(part.shape[1], dtype=np.uint64), part.shape[:2]).copy()
    for k in range(ROWS):
        out = ts.mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Exact weighted Jaccard similarity of two arrays of shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, "text", _STEP_BYTES):
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            hashes, begin = shingles(part.column("text"))
            points = signatures(hashes, begin)
            keys = band_keys(points)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            own = ["doc_id", "k1", "k2", "h1", "h2"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(np.diff(begin)), bands, pa.array([x.tobytes() for x in sketches(points)], pa.binary())], names=[*own, "n", "bands", "sketch"])


def sketches(earliest: np.ndarray) -> np.ndarray:
    """A byte for each register: equal registers have equal bytes, others 1 in 256 times."""
    return (ts.mix(earliest.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def _bytes(column: pa.Array) -> np.ndarray:
    data, offsets = ts.flat(column)
    return data.reshape(len(column), -1) if len(column) else np.zeros((0, BANDS * ROWS), np.uint8)


def _alike(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough for the threshold."""
    for batch in rows:
        keep = pa.array((_bytes(batch.column("sketch_a")) == _bytes(batch.column("sketch_b"))).mean(axis=1) >= ESTIMATE if batch.num_rows else [], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _verify(threshold: float):
    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches(iter([whole]), "text_a", _STEP_BYTES):
                left, at = shingles(batch.column("text_a"))
                right, to = shingles(batch.column("text_b"))
                similarity = np.array([overlap(left[at[i] : at[i + 1]], right[to[i] : to[i + 1]]) for i in range(batch.num_rows)])
                keep = pa.array(similarity >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(similarity).filter(keep)], names=["a", "b", "similarity"])

    return verify


def overlaps(hashes: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarities of texts ``left`` with texts ``right``, as a matrix."""
    if len(left) * len(right) <= 16:
        return np.array([[overlap(hashes[begin[i] : begin[i + 1]], hashes[begin[j] : begin[j + 1]]) for j in right] for i in left])
    sides = []
    for rows in (left, right):
        size = np.diff(begin)[rows]
        of, value = np.repeat(np.arange(len(rows)), size), hashes[ts.ranges(begin[:-1][rows], size)]
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))) if len(of) else np.zeros(0, np.int64)
        nth = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        sides.append((of, ts.mix(value + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))  # the n-th copy of a shingle is a feature
    shared = np.intersect1d(sides[0][1], sides[1][1])
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(shared), 4096):
        part = shared[a : a + 4096]
        planes = []
        for (of, value), rows in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[at] == value
            plane = np.zeros((len(rows), len(part)), np.float32)
            plane[of[hit], at[hit]] = 1
            planes.append(plane)
        both += planes[0] @ planes[1].T
    size = np.diff(begin)
    either = size[left][:, None] + size[right][None, :] - both
    return both / np.maximum(either, 1)


def _blocks(table: pa.Table, *keys: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, left, right) of each pair of blocks in a unit; left and right are positions in the rows."""
    columns = [table.column(c).to_numpy() for c in (*keys, "i", "j")]
    side = table.column("side").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), side, *columns[::-1]))
    sorted_ = np.stack(columns)[:, order]
    cuts = np.flatnonzero(np.append(True, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)))
    for own in np.split(order, cuts[1:]):
        left, right = np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)
        if len(left) and len(right):
            yield own, left, right


def _edges(near: Callable, *keys: str) -> Callable[[pa.Table], pa.Table]:
    """Forest edges of the links ``near(table, rows, left, right)`` between different components."""

    def edges(table: pa.Table) -> pa.Table:
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        table = table.combine_chunks()
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, left, right in _blocks(table, *keys):
            linked = near(table, own, left, right)
            linked &= component[own[left]][:, None] != component[own[right]][None, :]
            if linked.any():
                label = spanning_forest(linked, left, right, len(own))
                moved = np.flatnonzero(label != np.arange(len(own)))
                out_a.append(node[own[moved]])
                out_b.append(node[own[label[moved]]])
        return pa.table([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return edges


def _near_sketches(similarity: float) -> Callable:
    def near(table: pa.Table, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x, n = _bytes(table.column("sketch").take(pa.array(own))), table.column("n").to_numpy()[own].astype(float)
        same = np.zeros((len(left), len(right)), np.uint8)
        for k in range(x.shape[1]):
            same += x[left, k][:, None] == x[right, k][None, :]
        sizes = np.minimum(n[left][:, None], n[right][None, :]) >= similarity * np.maximum(n[left][:, None], n[right][None, :])
        return (same >= ESTIMATE * x.shape[1]) & sizes

    return near


def _near_texts(similarity: float) -> Callable:
    def near(table: pa.Table, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return overlaps(*shingles(table.column("text").take(pa.array(own))), left, right) >= similarity

    return near


def _dealt(rows: DataFrame, groups: DataFrame, key: str, block: int, unit_rows: int, columns: list[str], total: int) -> DataFrame:
    """Rows dealt as pairs of blocks: each row outside its group's main component meets all rows of the group.

    A group's blocks lie in many units, so no task holds it; units follow the rows dealt.
    """
    sized = groups.withColumn("lefts", F.ceil((F.col("all") - F.col("own")) / block).cast("int")).withColumn("rights", F.ceil(F.col("all") / block).cast("int"))
    count = sized.agg(F.sum((F.col("all") - F.col("own")) * F.col("rights") + F.col("all") * F.col("lefts"))).first()[0] or 0
    whole = join_sized(rows, sized, [key], "all", total)
    place = lambda salt, blocks: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rest = whole.where("component <> main").select(key, *columns, F.lit(0).alias("side"), place(0, "lefts").alias("i"), each("rights").alias("j"))
    every = whole.select(key, *columns, F.lit(1).alias("side"), place(1, "rights").alias("j"), each("lefts").alias("i"))
    return rest.unionByName(every).withColumn("unit", F.pmod(F.xxhash64(key, "i", "j"), F.lit(max(16, count // unit_rows))))


def _mixed(rows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, main, own, all) of the groups of ``least`` rows or more with several components; ``main`` is the largest."""
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("own"))
    whole = sizes.groupBy(key).agg(F.max(F.struct("own", "component")).alias("m"), F.sum("own").alias("all"), F.count(F.lit(1)).alias("parts"))
    return cut(whole.where((F.col("parts") > 1) & (F.col("all") >= least)).select(key, F.col("m.component").alias("main"), F.col("m.own").alias("own"), "all"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, k1, k2, class_id, kept and class_size for every document.

    Documents of equal text are one node. Nodes that share a band are candidates: each is
    verified against its bucket's hub, the member that meets most others over all bands.
    In buckets that this leaves in several components, members outside the largest one meet
    all others by their sketches, in blocks and without a row for a pair; nodes that sketches
    link are a family, whose components are compared by their texts in the same way. So a
    candidate pair is left out only where its sketches agree too seldom (see ESTIMATE), and a
    bucket of copies costs little more than one test a member. Members of one bucket that all
    differ are compared pair by pair, in numpy.

    class_id is the least doc_id of a connected class, and its document is kept; rows that
    repeat both id and text of it are kept, too. Null texts are empty; texts without words
    are one class if equal and link with nothing else. A null doc_id is larger than all
    ids; a class of null ids only has a null class_id. Of documents with one id the one of
    least key counts as least. Long texts are compared whole; other columns are not read, and
    an empty table gives no rows.
    """
    h1, h2 = hashes("text")
    rows = keyed(docs, doc_id, text).select("*", h1.alias("h1"), h2.alias("h2"))
    signed = cut(rows.mapInArrow(_sign, "doc_id long, k1 long, k2 long, h1 long, h2 long, n long, bands array<long>, sketch binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2"))
    nodes = numbered(signed.groupBy("h1", "h2").agg(first.alias("s"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "node")
    total = nodes.count()
    bands = nodes.where("n > 0").select("node", F.explode("bands").alias("key"))
    met = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = cut(join_sized(bands, met, ["key"], "size", total * BANDS))
    popular = cut(members.groupBy("node").agg(F.sum("size").alias("meets")).join(nodes.select("node", "n", F.col("s.k1").alias("k1"), F.col("s.k2").alias("k2"), "sketch"), "node"))
    texts = cut(rows.select("k1", "k2", "text").join(popular.select("k1", "k2", "node"), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text")))
    hubs = members.join(popular.select("node", "meets", "n"), "node")
    hub = cut(hubs.groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("rows")))
    stars = join_sized(hubs, hub, ["key"], "rows", total * BANDS).where("node <> hub.node").where(F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n")).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: popular.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    near = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike, "a long, b long")
    near = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    found = components(near.select("a", "b", "text_a", "text_b").mapInArrow(_verify(similarity), "a long, b long, similarity double").select("a", "b"))

    part = popular.select("node", "n", "sketch").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = members.select("key", "node").join(part, "node")
    open_ = _mixed(placed, "key", 3)  # two members were compared as hub and member
    alike = _dealt(placed, open_, "key", SKETCH_BLOCK, SKETCH_UNIT_ROWS, ["node", "component", "n", "sketch"], total * BANDS)
    families = components(alike.groupBy("unit").applyInArrow(_edges(_near_sketches(similarity), "key"), "a long, b long")).withColumnRenamed("component", "family")
    families = cut(families.join(part.select("node", "component"), "node").join(texts, "node"))
    dealt = _dealt(families, _mixed(families, "family", 2), "family", BLOCK, UNIT_ROWS, ["node", "component", "text"], total)
    extra = cut(dealt.groupBy("unit").applyInArrow(_edges(_near_texts(similarity), "family"), "a long, b long"))
    if not extra.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra))

    own = nodes.select("h1", "h2", "node", "s", "copies")
    grouped = cut(own.join(found, "node"))
    least = cut(grouped.groupBy("component").agg(F.min("s").alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")))
    classed = join_sized(grouped, least, ["component"], "members", total).select("h1", "h2", "copies", "first", "class_size")
    alone = own.join(grouped.select("node"), "node", "left_anti").select("h1", "h2", "copies", F.col("s").alias("first"), F.col("copies").alias("class_size"))
    classes = cut(classed.unionByName(alone))
    out = join_sized(signed.select("doc_id", "k1", "k2", "h1", "h2"), classes, ["h1", "h2"], "copies", signed.count())
    return out.select("doc_id", "k1", "k2", F.col("first.doc_id").alias("class_id"), ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("kept"), "class_size")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns; of repeated rows one stays.

    An empty table stays empty; a null text stays null.
    """
    a, b = unused("k1", docs), unused("k2", docs)
    found = near_duplicates(docs.select(doc_id, text), doc_id=doc_id, text=text, similarity=similarity)
    kept = found.where("kept").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = hashes(doc_id, text)
    return docs.withColumns({a: k1, b: k2}).join(kept, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
