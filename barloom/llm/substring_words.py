"""Substring dedup over words: super-k-mer partitioning, then sorted windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .windows import covered, remove_shared_windows

WINDOW_WORDS = 50
GRAM_WORDS = 8


def sort_windows(segments: pa.Array, least_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort all windows of packed strings; for each, the least doc with the same words."""
    data, offsets = ts.flat(segments)
    starts, ends, first = ts.words(data, offsets)
    size = ends - starts
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data[ts.ranges(starts, size)])])
    ids = spans.dictionary_encode().indices.to_numpy()  # exact: equal ids, equal words
    counts = np.maximum(np.diff(first) - width + 1, 0)
    at, segment = ts.ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)
    a, b = (ts.run_hashes(ts.mix(ids.astype(np.uint64) + np.uint64(salt)), at, width) for salt in (0x51ED27, 0xC0FFEE1234))
    order = np.lexsort((b, a))
    new = np.ones(len(at), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    for k in range(width):  # neighbours in the order are compared word by word
        same = np.flatnonzero(~new)
        new[same] = ids[at[order[same]] + k] != ids[at[order[same - 1]] + k]
    begin = np.flatnonzero(new)
    winner = np.empty(len(at), np.int64)
    if len(at):
        winner[order] = np.repeat(np.minimum.reduceat(least_doc[segment[order]], begin), np.diff(np.append(begin, len(at))))
    return segment, at - first[segment], winner


def keep_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space) of one text."""
    words = text.split()  # bytes.split knows just the contract's six blanks
    if not len(starts):
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), starts, ends)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n, removed, kept = keep_words(text, starts, ends)
    return n, removed, hashlib.sha256(kept).hexdigest()


def _text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n, removed, kept = keep_words(text, starts, ends)
    return n, removed, kept.decode()


def remove_repeated_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text after removal of words in windows that start in a smaller document.

    Texts under ``window`` words, null and empty texts lose nothing; see
    :func:`barloom.llm.windows.remove_shared_windows` for null ids and repeated rows.
    """
    return remove_shared_windows(docs, by_words=True, width=window, gram=min(gram, window), solver=sort_windows, finish=_text, out="n_words long, n_removed long, kept_text string", doc_id=doc_id, text=text)


def repeated_words_digest(docs: DataFrame, **options) -> DataFrame:
    """As :func:`remove_repeated_words`, with the SHA-256 of the kept text in its place."""
    window, gram = options.pop("window", WINDOW_WORDS), options.pop("gram", GRAM_WORDS)
    return remove_shared_windows(docs, by_words=True, width=window, gram=min(gram, window), solver=sort_windows, finish=_digest, out="n_words long, n_removed long, kept_sha256 string", **options)
