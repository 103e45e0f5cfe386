"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

Impacts are divided by the score that an item has for its own text, so one
threshold serves all items. Block-max WAND runs for a batch of passages at once:
a frequent word's list is walked only where it gives an item much, the rest of it
adds its maximum to what the walked lists give; an item is a pivot where that sum
reaches the threshold, stays one where the maxima of its block do, and is then
scored in full. Where the maxima alone reach the threshold, blocks of items whose
own maxima do not are skipped whole. So every item above the threshold is found. Word shingles verify it: those
of the whole item, or those of its question and those of its answer, both in one
passage, whatever stands between them. A question without its answer is a hit
only where the whole item's shingles reach the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import cut

SHINGLE_WORDS = 5
OVERLAP = 0.8
#: Share of an item's own BM25 score that a passage must reach.
SCORE = 0.5
K1, B = 1.2, 0.75
PASSAGE_WORDS = 128
#: Words that may stand between question and answer for passages to be sure to hold both.
GAP_WORDS = 16
BLOCK = 8
#: Share of an item's own score from which a frequent word's posting is walked; an item has ten of these at most.
HEAVY = 0.1
#: Bytes of item text that one index holds; a larger benchmark is split over several.
INDEX_BYTES = 32 << 20
_STEP_BYTES = 2 << 20
_SPACE = np.ones(256, bool)
_SPACE[128:] = False
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _SPACE[_c] = False
_HIT = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passages", pa.int64())])
HIT = "item_id long, score double, overlap double, question_overlap double, answer_overlap double, passages long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and non-ASCII, lower-cased), and where each text's begin."""
    data, offsets = ts.flat(pc.utf8_lower(texts))
    starts, ends, first = ts.words(data, offsets, _SPACE)
    return ts.span_hashes(data, starts, ends), first


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what stands before it its question."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def _shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Distinct shingles and their length: that of the text if it is shorter than a shingle."""
    n = min(SHINGLE_WORDS, len(words))
    return n, np.unique(ts.sequence_hashes(words, n)) if n else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Index:
    ids: list[int | None]
    #: sorted word hashes; the walked postings of word w are rows begin[w] to begin[w + 1]
    words: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    #: the most that the postings which are not walked add to any item, and to any item of a block (rows by ``frequent``)
    most: np.ndarray
    frequent: np.ndarray
    block_most: np.ndarray
    #: words and impacts of each item
    own_words: list[np.ndarray]
    own_impacts: list[np.ndarray]
    whole: list[tuple[int, np.ndarray]]
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    longest: int


def build(items: list[tuple[int | None, str]]) -> Index:
    """Index items, short ones first, so that the items of a block are alike; those without words can't be met and are left out."""
    hashes, first = tokens(pa.array([t for _, t in items], pa.string()))
    keep = sorted((i for i in range(len(items)) if first[i + 1] > first[i]), key=lambda i: first[i + 1] - first[i])
    own = [hashes[first[i] : first[i + 1]] for i in keep]
    ids = [items[i][0] for i in keep]
    size = np.array([len(w) for w in own], float)
    words, code = np.unique(np.concatenate(own), return_inverse=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pair, tf = np.unique(code * np.int64(len(own) + 1) + np.repeat(np.arange(len(own)), size.astype(int)), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    word, item = pair // (len(own) + 1), pair % (len(own) + 1)
    df = np.bincount(word, minlength=len(words))
    idf = np.log(1 + (len(own) - df + 0.5) / (df + 0.5))
    impact = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / (size.mean() if own else 1)))
    impact = impact / np.bincount(item, weights=impact, minlength=len(own))[item]
    by_item = np.argsort(item, kind="stable")
    cuts = np.cumsum(np.bincount(item, minlength=len(own)))[:-1]
    own_words, own_impacts = np.split(word[by_item], cuts), np.split(impact[by_item], cuts)
    rest = (df > max(10, len(own) // 10))[word] & (impact < HEAVY)
    most = np.zeros(len(words))
    np.maximum.at(most, word[rest], impact[rest])
    frequent = np.where(most > 0, np.cumsum(most > 0) - 1, -1)
    block_most = np.zeros((int((most > 0).sum()), -(-len(own) // BLOCK)))
    np.maximum.at(block_most, (frequent[word[rest]], item[rest] // BLOCK), impact[rest])
    walked = ~rest
    begin = np.append(0, np.cumsum(np.bincount(word[walked], minlength=len(words))))
    parts = [question_and_answer(items[i][1]) for i in keep]
    sides = []
    for k in (0, 1):
        h, f = tokens(pa.array([p[k] for p in parts], pa.string()))
        sides.append([_shingles(h[f[i] : f[i + 1]]) for i in range(len(parts))])
    return Index(ids, words, begin, item[walked], impact[walked], most, frequent, block_most, own_words, own_impacts, [_shingles(w) for w in own], *sides, int(size.max()) if own else 0)


def wand(index: Index, passage: np.ndarray, word: np.ndarray, passages: int, threshold: float) -> list[tuple[int, int, float]]:
    """Every (passage, item, score) at or above the threshold; the input is each passage's distinct words, sorted by passage."""
    floor = threshold - 1e-9
    rest = np.bincount(passage, index.most[word], passages)  # maxima of what is not walked
    size = index.begin[word + 1] - index.begin[word]
    posting = ts.ranges(index.begin[word], size)
    items = len(index.ids)
    key = np.repeat(passage, size) * items + index.item[posting]
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    score = np.add.reduceat(index.impact[posting][order], at) if len(at) else np.zeros(0)
    pivot = key[order][at]
    keep = score + rest[pivot // items] >= floor
    pivot, score = pivot[keep], score[keep]
    often = index.frequent[word] >= 0
    listed, row = passage[often], index.frequent[word[often]]
    first = np.searchsorted(listed, np.arange(passages + 1))
    # passages whose frequent words could do it alone: the items of blocks where they can are pivots, too
    for p in np.flatnonzero(rest >= floor).tolist():
        bound = index.block_most[row[first[p] : first[p + 1]]].sum(axis=0)
        block = np.flatnonzero(bound >= floor)
        if len(block):
            every = (p * items + (block[:, None] * BLOCK + np.arange(BLOCK))).ravel()
            every = np.setdiff1d(every[every < (p + 1) * items], pivot)
            pivot, score = np.concatenate([pivot, every]), np.concatenate([score, np.zeros(len(every))])
    # the maxima of the pivot's block, over the frequent words of its passage
    for chunk in range(0, len(pivot), 50_000):
        own = slice(chunk, chunk + 50_000)
        n = np.diff(first)[pivot[own] // items]
        bound = index.block_most[row[ts.ranges(first[pivot[own] // items], n)], np.repeat(pivot[own] % items // BLOCK, n)]
        score[own] += np.bincount(np.repeat(np.arange(len(n)), n), bound, len(n))
    pivot = pivot[score >= floor]
    lo, hi = np.searchsorted(passage, pivot // items), np.searchsorted(passage, pivot // items, side="right")
    found = []
    for p, a, b in zip(pivot.tolist(), lo, hi, strict=True):
        full = float(index.own_impacts[p % items][np.isin(index.own_words[p % items], word[a:b], assume_unique=True)].sum())
        if full >= floor:
            found.append((p // items, p % items, full))
    return sorted(found)


def _share(wanted: tuple[int, np.ndarray], have: dict[int, np.ndarray]) -> float:
    n, words = wanted
    return float(np.isin(words, have[n], assume_unique=True).mean()) if n else 1.0


def search(index: Index, texts: pa.Array, overlap: float = OVERLAP, threshold: float = SCORE) -> list[list[dict]]:
    """For each text the verified items, by item; passages overlap so that each item lies whole in one, GAP_WORDS between its parts included."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not index.ids:
        return out
    hashes, first = tokens(texts)
    reach = index.longest + GAP_WORDS
    size = max(PASSAGE_WORDS, 2 * reach)
    stride = size - reach
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - size) // stride), 0) + 1, 0)
    of = np.repeat(np.arange(len(n)), count)
    start = first[of] + ts.ranges(np.zeros(len(n), np.int64), count) * stride
    stop = np.minimum(start + size, first[of + 1])
    where = np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)
    known = index.words[where] == hashes
    at = ts.ranges(start, stop - start)
    passage = np.repeat(np.arange(len(start)), stop - start)[known[at]]
    pair = np.unique(passage * len(index.words) + where[at[known[at]]])
    best: dict[tuple[int, int], dict] = {}
    have: dict[int, dict[int, np.ndarray]] = {}
    for p, item, score in wand(index, pair // len(index.words), pair % len(index.words), len(start), threshold):
        if p not in have:
            have = {p: {k: np.unique(ts.sequence_hashes(hashes[start[p] : stop[p]], k)) for k in range(1, SHINGLE_WORDS + 1)}}
        whole, question, answer = (_share(side[item], have[p]) for side in (index.whole, index.question, index.answer))
        if whole < overlap and min(question, answer) < overlap:
            continue
        hit = best.setdefault((int(of[p]), item), {"item_id": index.ids[item], "score": 0.0, "overlap": 0.0, "question_overlap": 0.0, "answer_overlap": 0.0, "passages": 0})
        hit["passages"] += 1
        for name, value in (("score", score), ("overlap", whole), ("question_overlap", question), ("answer_overlap", answer)):
            hit[name] = max(hit[name], value)
    for (text, _), hit in sorted(best.items(), key=lambda x: x[0]):
        out[text].append(hit)
    return out


def indexes(items: DataFrame, *, item_id: str = "item_id", text: str = "text", most_bytes: int = INDEX_BYTES) -> tuple[int, Iterator[Index]]:
    """How many indexes of at most some ``most_bytes`` of text the items take, and these one at a time.

    The size is checked before anything is gathered; the driver never holds more than one.
    """
    known = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))

    def made() -> Iterator[Index]:
        for k in range(parts):
            own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
            yield build(sorted(((r["item_id"], r["text"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

    return parts, made()


def leaks(index: Index, text: Column, *, overlap: float = OVERLAP, threshold: float = SCORE) -> Column:
    """Array of verified hits of a text column (see HIT); empty for null and clean texts."""

    @F.arrow_udf(f"array<struct<{HIT.replace(' long', ':long').replace(' double', ':double').replace(', ', ',')}>>")
    def udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            size = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False)) if len(part) else np.zeros(0, int)
            cuts = np.append(np.flatnonzero(np.diff(size // _STEP_BYTES, prepend=-1)), len(size))
            rows: list[list[dict]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows += search(index, part.slice(a, b - a), overlap, threshold)
            yield pa.array(rows, pa.list_(_HIT))

    return udf(text)


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it holds; clean documents have none.

    Null and empty texts hold nothing; items without words are never met, and an empty table
    on either side gives no rows. Repeated documents each get their rows, repeated items
    count once; a null doc_id or item_id comes back as null. An item that a document holds
    several times is one row with the best of each score (of equal ones any) and the count
    of passages. Long texts are searched whole, passage by passage; other columns are not
    read. A benchmark above ``most_bytes`` takes a pass over the documents for each part.
    """
    parts, made = indexes(items, item_id=item_id, text=item_text, most_bytes=most_bytes)
    out: DataFrame | None = None
    for index in made:
        hits = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(leaks(index, F.col(text))).alias("h")).select("doc_id", "h.*")
        hits = cut(hits) if parts > 1 else hits
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, unchanged; see :func:`contaminated`."""
    parts, made = indexes(items, item_id=item_id, text=item_text, most_bytes=most_bytes)
    for index in made:
        docs = docs.where(F.size(leaks(index, F.col(text))) == 0)
        docs = cut(docs) if parts > 1 else docs
    return docs
