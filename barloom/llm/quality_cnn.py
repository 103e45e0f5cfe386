"""Quality classifier: a byte-level convolutional network, in numpy.

Bytes have learned vectors; learned filters slide over overlapping chunks that
cover the whole text. Each chunk keeps the most that each filter finds in it; a
text's mean and maximum over its chunks go into one logistic unit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import hashes

WIDTH = 7
STRIDE = 2
FILTERS = 16
VECTOR = 8
#: Filter positions a chunk; chunks overlap by the filter's reach beyond them.
POSITIONS = 256
#: Rows that the fit takes of labels 0 and 1; it learns from all chunks of their texts.
FIT_ROWS = (900, 2700)
EPOCHS = 14
THRESHOLD = 0.3
_CHUNK = POSITIONS * STRIDE + WIDTH - 1
_STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    #: (WIDTH, 256, FILTERS): what each byte at each place adds to each filter
    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def _chunks(text: bytes, most: int | None = None) -> np.ndarray:
    """All chunks of a text, for training, or up to ``most`` spread over the whole of it."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(data) // (POSITIONS * STRIDE)))
    at = np.unique(np.linspace(0, n - 1, min(n, most or n)).astype(int)) * POSITIONS * STRIDE
    out = np.zeros((len(at), _CHUNK), np.uint8)
    for i, a in enumerate(at):
        piece = data[a : a + _CHUNK]
        out[i, : len(piece)] = piece
    return out


def train(data: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, weights: np.ndarray | None = None) -> Model:
    """Minimise log loss by Adam over texts given as matrices of chunks; label 1 is good.

    ``weights``: how many rows each text stands for; their scale is immaterial.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (256, VECTOR))
    filt = rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS))
    bias, w, c = np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), 0.0
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else 4.0 if labels[0] else -4.0
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), sure)
    weights = np.ones(len(data)) if weights is None else weights / weights.mean()
    params = [emb, filt, bias, w, np.array([c])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    reach = np.arange(0, POSITIONS * STRIDE, STRIDE)
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(data))
        for at in range(0, len(order), 32):
            ids = order[at : at + 32]
            parts = [data[i] for i in ids]
            size = np.array([len(p) for p in parts])
            x = np.concatenate(parts)
            tables = np.einsum("bv,kvf->kbf", params[0], params[1]).astype(np.float32)
            top, peak = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS))  # chunk, filter
            for a in range(0, len(x), 64):
                hit = sum(tables[k][x[a : a + 64, reach + k]] for k in range(WIDTH))
                top[a : a + 64] = hit.argmax(axis=1)
                peak[a : a + 64] = hit.max(axis=1)
            peak += params[2]
            relu = np.tanh(np.maximum(peak, 0))
            begin = np.cumsum(size) - size
            mean = np.add.reduceat(relu, begin) / size[:, None]
            of = np.repeat(np.arange(len(ids)), size)
            most = np.maximum.reduceat(relu, begin)
            z = mean @ params[3][:FILTERS] + most @ params[3][FILTERS:] + params[4][0]
            miss = weights[ids] * (1 / (1 + np.exp(-z)) - labels[ids]) / len(ids)
            grad_w = np.concatenate([mean.T @ miss, most.T @ miss])
            back = (miss[:, None] * params[3][:FILTERS] / size[:, None])[of]
            back = back + (miss[:, None] * params[3][FILTERS:])[of] * (relu == most[of])
            back = back * (1 - relu**2) * (peak > 0)
            grad_table = np.zeros((WIDTH, 256, FILTERS))
            rows, columns = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(grad_table[k], (x[rows, top * STRIDE + k], np.broadcast_to(columns, top.shape)), back)
            grads = [np.einsum("kbf,kvf->bv", grad_table, params[1]), np.einsum("kbf,bv->kvf", grad_table, params[0]), back.sum(axis=0), grad_w + 1e-4 * params[3], np.array([miss.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    tables = np.einsum("bv,kvf->kbf", params[0], params[1]).astype(np.float32)
    return Model(tables, params[2].astype(np.float32), params[3], float(params[4][0]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each whole text; null and empty texts are one empty chunk."""
    data, offsets = ts.flat(texts)
    size = np.diff(offsets)
    chunks = np.maximum(-(-size // (POSITIONS * STRIDE)), 1)
    begin = np.cumsum(chunks) - chunks
    # each text is padded with zeros to whole chunks and the reach of the filters, as in training
    gap = WIDTH + WIDTH % STRIDE
    spaced = begin * POSITIONS * STRIDE + np.arange(len(size)) * gap
    padded = np.zeros(int(chunks.sum()) * POSITIONS * STRIDE + len(size) * gap, np.uint8)
    padded[ts.ranges(spaced, size)] = data
    total = int(chunks.sum())
    first = np.arange(total) * POSITIONS * STRIDE + np.repeat(np.arange(len(size)), chunks) * gap
    reach = np.arange(0, POSITIONS * STRIDE, STRIDE)
    best = np.empty((total, FILTERS), np.float32)
    for a in range(0, total, 64):
        at = (first[a : a + 64, None] + reach).ravel()
        hit = model.tables[0][padded[at]]
        for k in range(1, WIDTH):
            hit += model.tables[k][padded[at + k]]
        best[a : a + 64] = hit.reshape(-1, POSITIONS, FILTERS).max(axis=1)
    relu = np.tanh(np.maximum(best + model.bias, 0))
    mean = np.add.reduceat(relu, begin) / chunks[:, None]
    most = np.maximum.reduceat(relu, begin)
    z = mean @ model.weights[:FILTERS] + most @ model.weights[FILTERS:] + model.offset
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: tuple[int, int] = FIT_ROWS) -> Model:
    """Fit on a bounded sample: ``rows`` of labels 0 and 1, those of least id hash, so reruns agree, with their whole texts.

    The sample is drawn from the ids alone; texts are read where they lie and leave as
    chunks. Of several labels of an id the least counts, of several texts of an id the one
    of least key hash. Rows weigh as many as their label has for each that is sampled, so
    the classes keep their balance whatever the bounds. Other labels, null ones, null ids
    and labels without a document teach nothing. With one label only every text scores near it, without labels 0.5.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("label")).groupBy("id").agg(F.min("label").alias("label")).where(F.col("label").isin(0, 1))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), hashes(doc_id, text)[0].alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    present = known.join(texts.select("id").distinct(), "id", "left_semi").select("id", F.col("label").cast("int").alias("label"))
    first = [present.where(F.col("label") == name).orderBy(F.xxhash64("id"), "id").limit(most) for name, most in enumerate(rows)]
    sample = first[0].unionByName(first[1])

    def shorten(text: Column) -> Column:
        """The chunks of a text, cut out where it is."""

        @F.arrow_udf("array<binary>")
        def udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield pa.array([[c.tobytes() for c in _chunks(t)] for t in part.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))

        return udf(text)

    chunks = texts.join(F.broadcast(sample), "id").select("id", "label", "rid", shorten(F.col("text")).alias("chunks"))  # sum(rows) ids at most
    taken = chunks.groupBy("id", "label").agg(F.min_by("chunks", "rid").alias("chunks")).collect()
    taken.sort(key=lambda r: (r["label"], r["id"] * 0x9E3779B97F4A7C15 % 2**64))
    data = [np.frombuffer(b"".join(map(bytes, r["chunks"])), np.uint8).reshape(-1, _CHUNK) for r in taken]
    counted = {r["label"]: r["count"] for r in present.groupBy("label").count().collect()}
    sampled = Counter(r["label"] for r in taken)
    return train(data, np.array([r["label"] for r in taken], float), weights=np.array([counted[r["label"]] / sampled[r["label"]] for r in taken]))


def score(model: Model, text: Column) -> Column:
    """Probability, from 0 to 1, that a whole text has label 1 (good).

    Null and empty texts score as one empty chunk; a long text is read in all its chunks, and
    repeated rows score alike.
    """

    @F.arrow_udf("double")
    def udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            if not len(part):
                yield pa.array([], pa.float64())
                continue
            size = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False) + 64)
            cuts = np.append(np.flatnonzero(np.diff(size // _STEP_BYTES, prepend=-1)), len(size))
            yield pa.array(np.concatenate([scores(model, part.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))

    return udf(text)
