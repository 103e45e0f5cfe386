"""Mixing sources to target weights: packed blocks, drawn shards, permuted indices.

Each source's words are packed into blocks of fixed length in a fixed order of
its documents. An output shard draws how many of its slots go to each source;
the slots of a source are numbered through all shards and map, epoch by epoch,
through a pseudorandom permutation of its block indices. Blocks join by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import WORD, hashes, pieces, unused

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
MOST_EPOCHS = 3
#: Sources are configured, not found: more distinct ones than this are an error.
MOST_SOURCES = 100_000
SEED = 20
_SLOTS = "shard long, position long, source_index long, slot long, epoch long, block long, words long"
_PIECE = "shard:long,position:long,begin:long,words:long,text:string"


@dataclass(frozen=True)
class Share:
    """What the mix takes of one source: whole epochs of its blocks, then words of one more."""

    source: str | None
    words: int
    target: float
    epochs: int
    rest: int

    def blocks(self, block: int) -> int:
        return -(-self.words // block)


def targets(sizes: list[int], weights: list[float], most: float = MOST_EPOCHS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, each at most ``most`` times its size; what is cut off goes to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = math.fsum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / weight > most * sizes[i]] if weight else sorted(free)
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i]) if weight else 0.0
        left -= math.fsum(out[i] for i in over)
        free -= set(over)
    return out


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network, walked until it lands below n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            if inverse:
                left, right = right ^ (ts.mix(left + np.uint64((key * 4 + 3 - r) % 2**63)) & mask), left
            else:
                left, right = right, left ^ (ts.mix(right + np.uint64((key * 4 + r) % 2**63)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def slots_of(share: Share, key: int, block: int) -> tuple[int, int]:
    """(slots, words of the last one) that hold the share: the last is cut where the target is met."""
    n = share.blocks(block)
    if not share.words or not (share.epochs or share.rest):
        return 0, 0
    if not share.rest:
        return share.epochs * n, -1
    short = block * n - share.words  # what the last block lacks
    at = int(permute(np.array([n - 1]), n, key + share.epochs, inverse=True)[0])
    m = -(-share.rest // block)
    if m * block - (short if at < m else 0) < share.rest:
        m += 1
    before = (m - 1) * block - (short if at < m - 1 else 0)
    return share.epochs * n + m, share.rest - before


def hypergeometric(n: int, rest: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` draws without replacement from n + rest fall on the n: exact at every size.

    numpy's generator stops at 10^9; beyond it the same distribution is inverted from the
    ratios of its neighbouring probabilities, 40 standard deviations around the mode.
    """
    if n + rest < 10**9:
        return int(rng.hypergeometric(n, rest, take))
    whole = n + rest
    mode = (take + 1) * (n + 1) // (whole + 2)
    reach = int(40 * math.sqrt(take * (n / whole) * (rest / whole) * ((whole - take) / (whole - 1)))) + 40
    k = np.arange(max(mode - reach, take - rest, 0), min(mode + reach, n, take) + 1, dtype=np.float64)
    step = np.log(n - k[:-1]) + np.log(take - k[:-1]) - np.log(k[1:]) - np.log(rest - take + k[1:])
    chance = np.append(0.0, np.cumsum(step))
    chance = np.cumsum(np.exp(chance - chance.max()))
    return int(k[np.searchsorted(chance, rng.random() * chance[-1], side="right").clip(0, len(k) - 1)])


def _draw(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` draws fall on each source: multinomial, given what each has in all."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest = left - n
        got = 0 if take <= 0 or not n else take if rest == 0 else hypergeometric(n, rest, take, rng)
        out[i], take, left = got, take - got, rest
    return out


@lru_cache(64)
def _half(counts: tuple[int, ...], take: int, seed: int, lo: int, hi: int) -> tuple[int, ...]:
    """The draw of one half; neighbouring shards share all but the last of theirs."""
    return tuple(_draw(np.array(counts, np.int64), take, np.random.default_rng((seed, lo, hi))).tolist())


def shard_counts(totals: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, in this shard).

    The slots are split in halves down to the shard with one generator for each half, so
    every task finds its own counts alone, and all shards' counts add up to the totals.
    """
    lo, hi, before, here = 0, shards, np.zeros(len(totals), np.int64), totals.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.array(_half(tuple(here.tolist()), min((mid - lo) * size, int(here.sum())), seed, lo, hi))
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return before, here


@dataclass(frozen=True)
class Mix:
    shares: list[Share]
    #: one row a document: all its columns, size, source_index and where it starts in its source
    documents: DataFrame
    #: one row a slot: shard, position, source_index, slot, epoch, block, words (-1: the whole block)
    slots: DataFrame
    block: int


def _slots(spark: SparkSession, shares: list[Share], block: int, shard_slots: int, seed: int) -> DataFrame:
    keys = [seed * 1_000_003 + 101 * i for i in range(len(shares))]
    ends = [slots_of(s, k, block) for s, k in zip(shares, keys, strict=True)]
    totals = np.array([n for n, _ in ends], np.int64)
    sizes, last = [s.blocks(block) for s in shares], [w for _, w in ends]
    shards = max(1, -(-int(totals.sum()) // shard_slots)) if len(totals) else 1

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                before, here = shard_counts(totals, int(shard), shards, shard_slots, seed)
                source = np.repeat(np.arange(len(totals)), here)
                slot = ts.ranges(before, here)
                order = np.argsort(ts.mix(np.arange(len(slot), dtype=np.uint64) + ts.mix(np.array([shard + seed], np.uint64))), kind="stable")
                position = np.empty(len(slot), np.int64)
                position[order] = np.arange(len(slot))
                n = np.array(sizes or [1], np.int64)[source]
                epoch = slot // np.maximum(n, 1)
                index = np.empty(len(slot), np.int64)
                for s in np.unique(source):
                    for e in np.unique(epoch[source == s]):
                        own = (source == s) & (epoch == e)
                        index[own] = permute(slot[own] % sizes[s], sizes[s], keys[s] + int(e))
                words = np.where((slot == totals[source] - 1) & (np.array(last or [0])[source] >= 0), np.array(last or [0])[source], -1)
                yield pd.DataFrame({"shard": np.full(len(slot), shard), "position": position, "source_index": source, "slot": slot, "epoch": epoch, "block": index, "words": words})

    return spark.range(0, shards, 1, min(shards, 10_000)).mapInPandas(emit, _SLOTS)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Mix all documents; the sum of all sizes is shared out by weight.

    Sources in order of their code points, null last, take ``weights`` in turn. A null text
    has size 0. Documents of size 0 and sources without words take no slot. Rows that agree
    in all of id, text and source are each packed once; their order is immaterial. Long texts
    run over as many blocks as they need. A column of the input that has the name of a
    result column is renamed with underscores before it; an empty table gives an empty mix.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long") if size is None else F.coalesce(size, F.lit(0)).cast("long")
    made = ("size", "source_index", "start", "source_size", "target", "taken", "pieces", "places")
    docs = docs.withColumnsRenamed({c: unused(c, docs) for c in docs.columns if c.lower() in made})
    kept = [F.col(f"`{c}`") for c in docs.columns]
    n, name, k1, k2, bucket, begin, s2, at, b2, offset = (unused(f"__{c}", docs) for c in ("n", "name", "k1", "k2", "bucket", "begin", "s2", "at", "b2", "offset"))
    h1, h2 = hashes(doc_id, text)
    parts = pieces(docs.count(), 256, 1 << 16, 1 << 16, 64)
    own = docs.select("*", words.alias(n), F.col(source).cast("string").alias(name), h1.alias(k1), h2.alias(k2), F.pmod(h1, F.lit(parts)).alias(bucket))
    stats = own.groupBy(name, bucket).agg(F.sum(n).alias("n")).groupBy(name).agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    stats = sorted(((r[name], r["n"]) for r in stats), key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([n for _, n in stats], [weights[i % len(weights)] for i in range(len(stats))])
    shares = [Share(s, n, t, *(divmod(min(round(t), MOST_EPOCHS * n), n) if n else (0, 0))) for (s, n), t in zip(stats, wanted, strict=True)]
    spark = docs.sparkSession
    index = spark.createDataFrame([(i, s.source, s.words, s.target) for i, s in enumerate(shares)], f"source_index long, {s2} string, source_size long, target double")
    own = own.join(F.broadcast(index), F.col(name).eqNullSafe(F.col(s2)))  # MOST_SOURCES rows at most
    # where a document starts: sums of the buckets before its own, then inside the bucket; no source sits in one task.
    # the join and the window share one exchange: both deal by the source's number, which is never null, and the bucket
    sums = own.groupBy(F.col("source_index").alias(at), F.col(bucket).alias(b2)).agg(F.sum(n).alias(n))
    offsets = sums.select(at, b2, (F.sum(n).over(Window.partitionBy(at).orderBy(b2)) - F.col(n)).alias(offset))
    within = Window.partitionBy("source_index", bucket).orderBy(k1, k2)
    placed = own.join(offsets.hint("shuffle_merge"), (F.col("source_index") == F.col(at)) & (F.col(bucket) == F.col(b2)))
    placed = placed.withColumn(begin, F.col(offset) + F.sum(n).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))
    documents = placed.select(*kept, F.col(n).alias("size"), "source_index", "source_size", "target", F.col(begin).alias("start"))
    return Mix(shares, documents, _slots(spark, shares, block, shard_slots, seed), block)


def _pieces(documents: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document has words in: where they begin in the block and in the document, and how many."""
    cut = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    return cut.withColumns({"begin": begin - F.col("block") * block, "first": begin - F.col("start"), "n": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin})


def _cut_words(text: Column, places: Column) -> Column:
    """The pieces of a text: each place with its words, joined by a space, and their number."""

    @F.arrow_udf(f"array<struct<{_PIECE}>>")
    def udf(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        longs = [(c, pa.int64()) for c in ("shard", "position", "begin", "words")]
        kind = pa.list_(pa.struct([*longs, ("text", pa.string())]))
        for texts, held in parts:
            rows = []
            for t, own in zip(texts.cast(pa.binary()).to_pylist(), held.to_pylist(), strict=True):
                w = t.split() if own else []
                cut = [w[p["first"] : p["first"] + p["n"]] for p in own or []]
                rows.append([{"shard": p["shard"], "position": p["position"], "begin": p["begin"], "words": len(c), "text": b" ".join(c).decode()} for p, c in zip(own or [], cut, strict=True)])
            yield pa.array(rows, kind)

    return udf(text, places)


def _placed(mixed: Mix, how: str) -> DataFrame:
    """The documents with ``places``: shard, position, begin in the block, first word and words of each piece."""
    part = _pieces(mixed.documents.select("source_index", "start", "size"), mixed.block)
    used = part.join(mixed.slots.select("source_index", "block", "shard", "position", "words").hint("shuffle_merge"), ["source_index", "block"])
    used = used.withColumn("n", F.when(F.col("words") < 0, F.col("n")).otherwise(F.least("n", F.col("words") - F.col("begin")))).where("n > 0")
    place = F.struct(*(F.col(c).cast("long").alias(c) for c in ("shard", "position", "begin", "first", "n")))
    i, at = (unused(f"__{c}", mixed.documents) for c in ("i", "at"))
    held = used.groupBy(F.col("source_index").alias(i), F.col("start").alias(at)).agg(F.array_sort(F.collect_list(place)).alias("places"))
    met = (F.col("source_index") == F.col(i)) & (F.col("start") == F.col(at)) & (F.col("size") > 0)
    return mixed.documents.join(held.hint("shuffle_merge"), met, how)


def taken_text(mixed: Mix, *columns: str, text: str = "text", unused_too: bool = False) -> DataFrame:
    """The documents that the mix takes words of, with ``taken`` and ``pieces``: all their text in it.

    A piece is a run of words with the shard, the position in it and the word of that block
    where it begins; the pieces of all documents in this order are the blocks. Each text is
    cut where its document is. ``taken`` counts the words of the pieces, repeats included.
    With ``unused_too`` the other documents are rows, too: none taken, no pieces.
    """
    out = _placed(mixed, "left" if unused_too else "inner").select(*columns, "size", "source_size", "target", _cut_words(F.coalesce(F.col(text), F.lit("")), F.col("places")).alias("pieces"))
    return out.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"]))


def mixed_blocks(mixed: Mix, text: str = "text") -> DataFrame:
    """(shard, position, source_index, text): the mix itself, block by block, words joined by a space."""
    words = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    pieces = _pieces(mixed.documents.select("source_index", "start", "size", words.alias("w")), mixed.block)
    pieces = pieces.select("source_index", "block", "begin", F.slice("w", (F.col("first") + 1).cast("int"), F.col("n").cast("int")).alias("w"))
    blocks = pieces.groupBy("source_index", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "w"))), lambda p: p["w"])).alias("w"))
    held = mixed.slots.join(blocks, ["source_index", "block"])
    cut = F.when(F.col("words") >= 0, F.slice("w", 1, F.greatest(F.col("words"), F.lit(0)).cast("int"))).otherwise(F.col("w"))
    return held.select("shard", "position", "source_index", F.array_join(cut, " ").alias("text"))
