"""Shared-window removal: one exchange plan for word windows and byte strings.

A *window* is ``width`` consecutive items (words or bytes) of one document. An
item is removed when a window that covers it also starts in a document with a
smaller doc_id. The plan keeps every pass linear:

1. Documents are dealt once into cells by row key; all passes over texts use that
   one exchange. Cells, buckets and tasks are sized by the bytes of the texts.
2. Each cell finds the minimiser of every window (the least hash of the grams in
   it) and sends each distinct minimiser once, packed, to the bucket of its hash.
   A minimiser seen in one document only cannot belong to a shared window.
3. Cells cut runs of windows with a shared minimiser (super-k-mers) out of their
   texts as packed strings. Of equal strings a cell sends one, with its least
   document: the other documents lose all windows of it, whatever the rest of the
   corpus holds. So a bucket gets a string that a third of all documents share
   once a cell. Runs of a minimiser that many documents hold are cut again where a
   second, independent minimiser changes, and dealt by both.
4. Equal windows have equal minimisers, so they meet in a bucket, where a solver
   compares them item by item, and the removed ranges go back to the cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import NULL_ID, keyed, pieces

#: Bytes of text that one numpy step takes.
STEP_BYTES = 2 << 20
#: Documents of a minimiser beyond which its runs are dealt by a second one, too.
SPREAD = 20_000
_CELLS, _BUCKETS, _TASKS = (4 << 20, 4096, 64 << 20), (8 << 20, 2048, 128 << 20), (8 << 20, 2048, 256 << 20)
_FOUND = "cell long, bucket long, hashes binary, docs binary"
_SHARED = "cell long, hashes binary, hot binary"
_PACKED = "bucket long, kind int, cell long, key binary, size binary, doc binary, copies binary, row binary, pos binary, n binary, bytes binary"
_RANGES = "cell long, row binary, pos binary, n binary"
SEGMENT, DONE = 0, 1


class Items:
    """Items of a batch of texts: words or bytes, with hashes of runs of them."""

    def __init__(self, texts: pa.Array, by_words: bool):
        self.data, self.offsets = ts.flat(texts)
        self.by_words = by_words
        if by_words:
            self.starts, self.ends, self.first = ts.words(self.data, self.offsets)
            self.hashes = ts.span_hashes(self.data, self.starts, self.ends)
        else:
            self.first = self.offsets

    def grams(self, n: int) -> np.ndarray:
        if self.by_words:
            return ts.sequence_hashes(self.hashes, n)
        at = np.arange(max(0, len(self.data) - n + 1))
        return ts.span_hashes(self.data, at, at + n)

    def span(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and lengths of runs of ``n`` items from ``at``."""
        if not self.by_words:
            return at, n
        return self.starts[at], self.ends[at + n - 1] - self.starts[at]


def window_starts(items: Items, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first item) of every window."""
    counts = np.maximum(np.diff(items.first) - width + 1, 0)
    return np.repeat(np.arange(len(counts)), counts), ts.ranges(items.first[:-1], counts)


def runs(text: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first item, windows, minimiser) of each run of neighbouring windows of one text that share their minimiser."""
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return text[begin], at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _canonical(table: pa.Table) -> pa.Table:
    """A cell's rows in the order of their keys, which is the same in every pass; a row's number in it names the row."""
    return table.take(pa.array(np.lexsort((table.column("k2").to_numpy(), table.column("k1").to_numpy()))))


def _steps(table: pa.Table):
    """(first row, slice) of a cell's rows of some STEP_BYTES each."""
    sizes = pa.compute.binary_length(table.column("text")).to_numpy()
    step = np.cumsum(sizes) // STEP_BYTES
    cuts = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(a), table.slice(a, b - a)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _read(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A packed column of all rows as one array, and how many entries each row holds."""
    data, offsets = ts.flat(table.column(name))
    return data.view(dtype) if len(data) else np.zeros(0, dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and where each key begins in it."""
    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.diff(key[order], prepend=key[order][:1] ^ key.dtype.type(1)) != 0) if len(key) else np.zeros(0, np.int64)


def _parts(key: np.ndarray) -> list[np.ndarray]:
    """Positions of each distinct key."""
    order, at = _groups(key)
    return [x for x in np.split(order, at[1:]) if len(x)]


def _once(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _find(by_words: bool, width: int, gram: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def find(table: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for first, part in _steps(table):
            items = Items(part.column("text"), by_words)
            text, at = window_starts(items, width)
            least = ts.sliding_min(items.grams(gram), width - gram + 1)
            text, _, _, least = runs(text, at, least[at])
            found.append(_once(least, text + first))
        hashes, _ = _once(*(np.concatenate(x) for x in zip(*found, strict=True)))
        begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        docs = np.minimum(np.diff(np.append(begin, len(hashes))), 2**16 - 1).astype(np.uint16)
        hashes = hashes[begin]
        bucket, low = _bucket(hashes, buckets), hashes.astype(np.uint32)
        cell = table.column("cell")[0].as_py()
        return _rows(_FOUND, [(cell, int(bucket[x[0]]), low[x].tobytes(), docs[x].tobytes()) for x in _parts(bucket)])

    return find


def _share(spread: int) -> Callable[[pa.Table], pa.Table]:
    def share(table: pa.Table) -> pa.Table:
        low, n = _read(table, "hashes", np.uint32)
        docs, _ = _read(table, "docs", np.uint16)
        cell = np.repeat(table.column("cell").to_numpy(), n)
        bucket = table.column("bucket")[0].as_py()
        order, at = _groups(low)
        total = np.add.reduceat(docs[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        total = np.repeat(total, np.diff(np.append(at, len(order))))
        keep = total >= 2
        low, cell, is_hot = low[order][keep], cell[order][keep], (total[keep] > spread).astype(np.uint8)
        key = (np.uint64(bucket) << np.uint64(32)) | low.astype(np.uint64)
        return _rows(_SHARED, [(int(cell[x[0]]), key[x].tobytes(), is_hot[x].tobytes()) for x in _parts(cell)])

    return share


def _pack(by_words: bool, width: int, gram: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pack(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _rows(_PACKED, [])
        known, _ = _read(shared, "hashes", np.uint64)
        is_hot, _ = _read(shared, "hot", np.uint8)
        order = np.argsort(known)
        known, is_hot = known[order], is_hot[order]
        table = _canonical(table)
        doc = table.column("doc_id").to_numpy()
        cell = table.column("cell")[0].as_py()
        found: list[tuple] = []
        for first, part in _steps(table):
            items = Items(part.column("text"), by_words)
            text, at = window_starts(items, width)
            grams = items.grams(gram)
            least = ts.sliding_min(grams, width - gram + 1)
            text, at, n, key = runs(text, at, least[at])
            own = (_bucket(key, buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
            where = np.minimum(np.searchsorted(known, own), len(known) - 1)
            keep = known[where] == own
            text, at, n, key, hot = text[keep], at[keep], n[keep], key[keep], is_hot[where[keep]] > 0
            if hot.any():
                start = ts.ranges(at[hot], n[hot])
                second = ts.sliding_min(ts.mix(grams + np.uint64(0x5EC0)), width - gram + 1)[start]
                split = runs(np.repeat(text[hot], n[hot]), start, ts.mix(np.repeat(key[hot], n[hot]) ^ ts.mix(second)))
                text, at, n, key = (np.concatenate((x[~hot], y)) for x, y in zip((text, at, n, key), split, strict=True))
            begin, size = items.span(at, n + width - 1)
            found.append((key, size, n, text + first, at - items.first[text], items.data[ts.ranges(begin, size)]))
        key, size, n, row, pos, data = (np.concatenate(x) for x in zip(*found, strict=True))
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data)])
        coded = strings.dictionary_encode()  # exact: equal codes, equal strings
        code = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), NULL_ID, np.int64)
        np.minimum.at(least, code, doc[row])
        beaten = doc[row] > least[code]
        rows = [(cell % buckets, DONE, cell, b"", b"", b"", b"", row[beaten].astype(np.int32).tobytes(), pos[beaten].tobytes(), (n[beaten] + width - 1).tobytes(), b"")] if beaten.any() else []
        stay = np.flatnonzero(~beaten)
        stay = stay[np.argsort(code[stay], kind="stable")]
        head = stay[np.flatnonzero(np.append(True, np.diff(code[stay]) != 0))] if len(stay) else stay  # one occurrence of each string, by code
        copies = np.bincount(code[stay], minlength=len(least)).astype(np.int32)
        begin = np.cumsum(size) - size
        after = np.cumsum(copies) - copies
        bucket = _bucket(key[head], buckets)
        for x in _parts(bucket):
            h = head[x]
            own = stay[ts.ranges(after[x], copies[x])]
            rows.append((int(bucket[x[0]]), SEGMENT, cell, key[h].tobytes(), size[h].tobytes(), least[x].tobytes(), copies[x].tobytes(), row[own].astype(np.int32).tobytes(), pos[own].tobytes(), b"", data[ts.ranges(begin[h], size[h])].tobytes()))
        return _rows(_PACKED, rows)

    return pack


def _solve(width: int, solver: Callable, shard_bytes: int) -> Callable[[pa.Table], pa.Table]:
    def ranges_of(cell: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[tuple]:
        return [(int(cell[x[0]]), row[x].tobytes(), pos[x].tobytes(), n[x].tobytes()) for x in _parts(cell)]

    def solve(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rows: list[tuple] = [(x["cell"], x["row"], x["pos"], x["n"]) for x in table.filter(pa.array(kind == DONE)).select(["cell", "row", "pos", "n"]).to_pylist()]
        segments = table.filter(pa.array(kind == SEGMENT))
        if segments.num_rows:
            key, held = _read(segments, "key", np.uint64)
            cell = np.repeat(segments.column("cell").to_numpy(), held)
            size, doc = (_read(segments, c, np.int64)[0] for c in ("size", "doc"))
            copies, row, pos = _read(segments, "copies", np.int32)[0], _read(segments, "row", np.int32)[0], _read(segments, "pos", np.int64)[0]
            after = np.cumsum(copies, dtype=np.int64) - copies
            data, _ = ts.flat(segments.column("bytes"))
            begin = np.cumsum(size) - size
            order = np.argsort(key, kind="stable")
            shard = np.cumsum(size[order]) // shard_bytes
            cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))  # a minimiser stays whole
            cuts = cuts[np.append(True, shard[cuts][1:] != shard[cuts][:-1])]
            for x in np.split(order, cuts[1:]):
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.append(0, np.cumsum(size[x])).astype(np.int64)), pa.py_buffer(data[ts.ranges(begin[x], size[x])])])
                coded = texts.dictionary_encode()
                code = coded.indices.to_numpy()
                smallest = np.full(len(coded.dictionary), NULL_ID, np.int64)
                np.minimum.at(smallest, code, doc[x])
                # (distinct string, window in it, least doc that starts the window)
                of, window, winner = solver(coded.dictionary, smallest, width)
                to = np.searchsorted(of, np.arange(len(smallest) + 1))
                counts = np.diff(to)[code]
                entry = ts.ranges(to[code], counts)
                own = np.repeat(x, counts)
                lost = winner[entry] < doc[own]
                own, at = own[lost], window[entry[lost]]
                new = np.ones(len(own), bool)  # neighbouring windows of a string make one range
                new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
                a = np.flatnonzero(new)
                if not len(a):
                    continue
                last = np.append(a[1:], len(own)) - 1
                many = copies[own[a]]  # each range for all occurrences of its string
                to = ts.ranges(after[own[a]], many)
                rows += ranges_of(np.repeat(cell[own[a]], many), row[to], pos[to] + np.repeat(at[a], many), np.repeat(at[last] - at[a] + width, many))
        return _rows(_RANGES, rows)

    return solve


def _keep(out: str, finish: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def keep(table: pa.Table, removed: pa.Table) -> pa.Table:
        row, _ = _read(removed, "row", np.int32)
        pos, _ = _read(removed, "pos", np.int64)
        n, _ = _read(removed, "n", np.int64)
        order = np.argsort(row, kind="stable")
        row, pos, n = row[order], pos[order], n[order]
        rows = []
        if not table.num_rows:
            return _rows(out, rows)
        for first, part in _steps(_canonical(table)):
            own = np.arange(first, first + part.num_rows)
            lo, hi = np.searchsorted(row, own), np.searchsorted(row, own, side="right")
            for k, text in enumerate(part.column("text").cast(pa.binary())):
                starts = pos[lo[k] : hi[k]]
                rows.append((part.column("doc_id")[k].as_py(), part.column("rows")[k].as_py(), *finish(text.as_py(), starts, starts + n[lo[k] : hi[k]])))
        return _rows(out, rows)

    return keep


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of items that lie in any of the ranges."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:length] > 0


def remove_shared_windows(docs: DataFrame, *, by_words: bool, width: int, gram: int, solver: Callable, finish: Callable, out: str, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD, shard_bytes: int = 1 << 20) -> DataFrame:
    """Apply ``finish(text, starts, ends)`` to every document with its removed item ranges.

    ``solver(strings, docs, width)`` gets the distinct packed strings of a shard and the
    least doc of each, and returns (string, window, least doc) sorted by string. ``out`` is
    the schema of what ``finish`` returns. ``spread`` moves work between buckets; the result
    does not depend on it.

    A null text is empty. A null doc_id counts as larger than all ids and comes back as
    null. Rows that agree in id and text are one document, which is processed once and
    returned as often as it is there; documents with one id and different texts do not
    remove each other's windows. An empty table gives no rows, other columns are not read.
    """
    whole = keyed(docs, doc_id, text)
    sizes = whole.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    most, total = sizes.agg(F.max("n"), F.sum("size")).first()
    if (most or 0) > 1:  # repeated rows are counted where they are read
        whole = whole.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    else:
        whole = whole.withColumn("rows", F.lit(1).cast("long"))
    cells, buckets, tasks = (pieces(total or 0, *size) for size in (_CELLS, _BUCKETS, _TASKS))
    dealt = whole.select(F.pmod("k1", F.lit(cells)).alias("cell"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "k1", "k2", "rows", "text").repartition(tasks, "cell")
    found = dealt.groupBy("cell").applyInArrow(_find(by_words, width, gram, buckets), _FOUND).repartition(tasks, "bucket")
    shared = found.groupBy("bucket").applyInArrow(_share(spread), _SHARED).repartition(tasks, "cell")
    packed = dealt.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(_pack(by_words, width, gram, buckets), _PACKED).repartition(tasks, "bucket")
    removed = packed.groupBy("bucket").applyInArrow(_solve(width, solver, shard_bytes), _RANGES).repartition(tasks, "cell")
    out = f"doc_id long, rows long, {out}"
    done = dealt.groupBy("cell").cogroup(removed.groupBy("cell")).applyInArrow(_keep(out, finish), out)
    if (most or 0) > 1:
        done = done.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).drop("rows")
