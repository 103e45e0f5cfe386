"""Substring dedup over bytes: suffix arrays by induced sorting, common prefixes in text order.

A shard's suffixes are classified, its leftmost-smaller (LMS) substrings sorted
and named, the string of names sorted in turn (by this routine again while the
alphabet is small against its length, else by doubling), and the whole array
induced from them. Each pass handles a first symbol at a time, in vectors: a
suffix of symbol c can only be induced from suffixes of symbol c or below
(L type) or above (S type), so the suffixes that wait in a bucket form waves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .windows import covered, remove_shared_windows

WINDOW_BYTES = 50
GRAM_BYTES = 16


def suffix_types(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the sentinel at the end is S."""
    n = len(symbols)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(symbols[1:].astype(np.int64) - symbols[:-1])
    step[-1] = 1
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _induce(symbols: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the order given."""
    n, k = len(symbols), len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int64)
    lms_symbol = symbols[lms].astype(np.int64)
    by_symbol = lms[np.argsort(lms_symbol, kind="stable")]
    lms_at = np.append(0, np.cumsum(np.bincount(lms_symbol, minlength=k)))

    def scatter(j: np.ndarray, heads: np.ndarray, up: bool) -> None:
        symbol = symbols[j]
        order = np.argsort(symbol, kind="stable")
        j, symbol = j[order], symbol[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(first, len(j)))
        rank = np.arange(len(j)) - np.repeat(first, size)
        which = symbol[first]
        if up:
            sa[np.repeat(heads[which], size) + rank] = j
            heads[which] += size
        else:
            sa[np.repeat(heads[which], size) - 1 - rank] = j
            heads[which] -= size

    def source(i: np.ndarray, of_small: bool) -> np.ndarray:
        j = i[i > 0] - 1
        return j[small[j] == of_small]

    heads = begins.copy()
    for c in range(k):
        done = int(begins[c])
        while done < heads[c]:  # one wave: what the last one put into this bucket
            wave = sa[done : heads[c]]
            done = int(heads[c])
            if len(j := source(wave, False)):
                scatter(j, heads, True)
        if len(j := source(by_symbol[lms_at[c] : lms_at[c + 1]], False)):
            scatter(j, heads, True)
    l_end = heads
    tails = ends.copy()
    for c in range(k - 1, -1, -1):
        done = int(ends[c])
        while done > tails[c]:
            wave = sa[tails[c] : done][::-1]
            done = int(tails[c])
            if len(j := source(wave, True)):
                scatter(j, tails, False)
        if len(j := source(sa[begins[c] : l_end[c]][::-1], True)):
            scatter(j, tails, False)
    sa[0] = n - 1  # the sentinel, which nothing induces
    return sa


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` names at least."""
    rank, step = names.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: len(key) - step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        step *= 2
        if step >= min(depth, len(key)) or new[-1] == len(key) - 1:
            return order


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of ``symbols``, whose last one is the only 0.

    With ``depth`` suffixes that agree in their first ``depth`` symbols may stand in any
    order among themselves; without it the order is total.
    """
    n = len(symbols)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(symbols)
    lms = np.flatnonzero(small & np.append(False, ~small[:-1]))
    counts = np.bincount(symbols)
    sa = _induce(symbols, small, lms, counts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]  # LMS substrings sorted
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    size = stop[order] - order + 1
    same = np.flatnonzero(size[1:] == size[:-1])  # neighbours of one length are compared symbol by symbol
    name = np.ones(len(order), np.int64)
    name[0] = 0
    if len(same):
        differ = symbols[ts.ranges(order[same], size[same])] != symbols[ts.ranges(order[same + 1], size[same])]
        name[same + 1] = np.logical_or.reduceat(differ, np.cumsum(size[same]) - size[same])
    name = np.cumsum(name)
    if name[-1] + 1 < len(lms):
        of = np.empty(n, np.int64)
        of[order] = name
        names = of[lms]
        if (name[-1] + 1) * 500 < len(lms):
            order = lms[suffix_array(names, depth)]
        else:
            order = lms[_doubling(names, len(names) if depth is None else depth // 2 + 2)]
    return _induce(symbols, small, order, counts)


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position in ``order`` but the first, the bytes (``limit`` at most) shared with the one before it."""
    word = np.zeros(len(data) + 64, np.uint64)
    padded = np.append(data, np.zeros(72, np.uint8)).astype(np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(8 * k)
    phi = np.empty(len(data), np.int64)
    phi[order[1:]] = order[:-1]
    at = np.sort(order[1:])  # text order: neighbours in memory are read together
    prefix = np.zeros(len(data), np.int64)
    for k in range(0, limit, 8):
        differ = word[at + k] ^ word[phi[at] + k]
        low = differ & (~differ + np.uint64(1))
        prefix[at] += np.where(differ == 0, 8, np.log2(np.where(differ == 0, 1, low).astype(np.float64)).astype(np.int64) // 8)
        at = at[differ == 0]
    return np.minimum(prefix[order[1:]], limit)


def suffix_windows(segments: pa.Array, least_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``width``-byte string of the packed strings, the least doc with an equal one."""
    data, offsets = ts.flat(segments)
    size = np.diff(offsets)
    spaced = offsets[:-1] + np.arange(len(size))
    place = ts.ranges(spaced, size)
    symbols = np.ones(len(data) + len(size) + 1, np.uint16)
    symbols[place] = data.astype(np.uint16) + 2
    symbols[-1] = 0
    held = np.zeros(len(symbols), np.uint8)
    held[place] = data
    counts = np.maximum(size - width + 1, 0)
    starts = ts.ranges(spaced, counts)
    segment = np.repeat(np.arange(len(size)), counts)
    if not len(starts):
        return segment, starts, starts
    of = np.full(len(symbols), -1, np.int64)
    of[starts] = segment
    sa = suffix_array(symbols, width)
    sa = sa[of[sa] >= 0]
    begin = np.flatnonzero(np.append(True, permuted_common_prefixes(held, sa, width) < width))
    winner = np.empty(len(symbols), np.int64)
    winner[sa] = np.repeat(np.minimum.reduceat(least_doc[of[sa]], begin), np.diff(np.append(begin, len(sa))))
    return segment, starts - spaced[segment], winner[starts]


def keep_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, removed runs, kept bytes) of one text."""
    if not len(starts):
        return len(text), 0, 0, text
    gone = covered(len(text), starts, ends)
    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    n, removed, runs, kept = keep_bytes(text, starts, ends)
    return n, removed, runs, hashlib.sha256(kept).hexdigest()


def _bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    return keep_bytes(text, starts, ends)


def remove_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) after removal of bytes in strings that start in a smaller document.

    The kept bytes may end amid a character, so they are binary. Texts under ``window``
    bytes, null and empty texts lose nothing; see
    :func:`barloom.llm.windows.remove_shared_windows` for null ids and repeated rows.
    """
    return remove_shared_windows(docs, by_words=False, width=window, gram=min(gram, window), solver=suffix_windows, finish=_bytes, out="n_bytes long, n_removed long, n_spans long, kept binary", doc_id=doc_id, text=text)


def repeated_bytes_digest(docs: DataFrame, **options) -> DataFrame:
    """As :func:`remove_repeated_bytes`, with the SHA-256 of the kept bytes in their place."""
    window, gram = options.pop("window", WINDOW_BYTES), options.pop("gram", GRAM_BYTES)
    return remove_shared_windows(docs, by_words=False, width=window, gram=min(gram, window), solver=suffix_windows, finish=_digest, out="n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)
