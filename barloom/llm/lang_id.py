"""Language ID: nearest of several centroids per language over TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import hashes

UNKNOWN = "und"
#: Hashed features; n-grams of 1 to 3 letters share them.
DIMENSIONS = 4096
CENTROIDS = 4
#: Rows that the fit takes: at most FIT_ROWS over all languages, PER_LANGUAGE of each.
FIT_ROWS = 4000
PER_LANGUAGE = 800
_STEP_BYTES = 1 << 20
_STEP_ROWS = 512
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: unit rows; ``owner`` is the language of each
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    #: the least cosine at which a text still belongs to a centroid
    radius: np.ndarray


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    step = np.maximum.accumulate(np.maximum(size // _STEP_BYTES, 0)) + np.arange(len(size)) // _STEP_ROWS
    cuts = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(size))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(a, b - a)


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of each text's letters, lower-cased; runs of anything else are one blank."""
    data, offsets = ts.flat(pc.utf8_lower(texts))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letter[points == c] = chr(c).isalpha()
    codes = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (text[1:] != text[:-1])  # the first of a run of blanks
    codes, text, letter = codes[keep], text[keep], letter[keep]
    out = np.zeros(len(texts) * DIMENSIONS)
    key = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        key = key[: len(codes) - n + 1] * np.uint64(0x110000) + codes[n - 1 :] if len(codes) >= n else key[:0]
        own = text[: len(key)] == text[n - 1 :] if len(key) else np.zeros(0, bool)
        if n == 1:
            own &= letter
        slot = (ts.mix(key[own] + np.uint64(n)) % np.uint64(DIMENSIONS)).astype(np.int64)
        out += np.bincount(text[: len(key)][own] * DIMENSIONS + slot, minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def has_letters(found: np.ndarray) -> np.ndarray:
    return found.any(axis=1)


def weigh(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of sublinear term frequency times idf; all 0 without letters."""
    x = np.log1p(found) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds, so that reruns agree."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centre = x[seeds]
    for _ in range(12):
        of = np.argmax(x @ centre.T, axis=1)
        centre = np.array([x[of == j].mean(axis=0) if (of == j).any() else centre[j] for j in range(len(centre))])
        centre /= np.maximum(np.sqrt((centre**2).sum(axis=1, keepdims=True)), 1e-12)
    return centre, np.argmax(x @ centre.T, axis=1)


def train(found: np.ndarray, labels: list[str]) -> Model:
    """Fit on hashed counts (rows without letters are left out)."""
    keep = has_letters(found) if len(found) else np.zeros(0, bool)
    found, names = found[keep] if len(found) else np.zeros((0, DIMENSIONS)), np.array(labels, object)[keep]
    languages = sorted(set(names))
    idf = np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1
    x = weigh(found, idf)
    centroids, owner, radius = [np.zeros((0, DIMENSIONS))], [], []
    for i, name in enumerate(languages):
        own = x[names == name]
        centre, of = _clusters(own, CENTROIDS)
        near = (own * centre[of]).sum(axis=1)
        centroids.append(centre)
        owner += [i] * len(centre)
        radius += [float(np.quantile(near[of == j], 0.01)) * 0.7 if (of == j).any() else 1.0 for j in range(len(centre))]
    return Model(languages, np.concatenate(centroids), np.array(owner, np.int64), idf, np.array(radius))


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", rows: int = FIT_ROWS, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows: ``per_language`` of each language, ``rows`` in all.

    The sample is the rows of least key hash, so reruns agree; repeated rows count once. It
    is drawn from keys alone, before any text moves. Of more than ``rows`` labels the most
    frequent are learned (of equal ones the first by name). Rows with a null label or
    without letters teach nothing; without any row, as from an empty table, the model knows
    no language. Sampled texts are read whole; other columns are not read.
    """
    k1, k2 = hashes(doc_id, text)
    known = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    keys = known.select("label", "k1", "k2").distinct()
    sizes = keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(rows)
    languages = sizes.count()
    if not languages:
        return train(np.zeros((0, DIMENSIONS)), [])
    each = max(1, min(per_language, rows // languages))
    share = F.pmod("k1", F.lit(1 << 30)) / F.lit(float(1 << 30))
    # some more than asked for: the exact cut follows
    drawn = keys.join(F.broadcast(sizes), "label").where(share * F.col("n") < each + 4 * math.sqrt(each) + 4).select("label", "k1", "k2").collect()
    taken: dict[str, list[tuple]] = {}
    for r in sorted(drawn, key=lambda r: (r["label"], r["k1"] % (1 << 30), r["k1"], r["k2"])):
        own = taken.setdefault(r["label"], [])
        if len(own) < each:
            own.append((r["label"], r["k1"], r["k2"]))
    chosen = labelled.sparkSession.createDataFrame([x for own in taken.values() for x in own], "label string, k1 long, k2 long")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in _steps(batch.column("text")):
                found = counts(part).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(part)) for c in ("label", "k1", "k2")), pa.array([v.tobytes() for v in found], pa.binary())], names=["label", "k1", "k2", "counts"])
                start += len(part)

    sampled = known.join(F.broadcast(chosen), ["label", "k1", "k2"]).mapInArrow(vectors, "label string, k1 long, k2 long, counts binary")  # ``rows`` keys at most
    sample = sampled.groupBy("label", "k1", "k2").agg(F.first("counts").alias("counts")).collect()
    sample.sort(key=lambda r: (r["label"], r["k1"] % (1 << 30), r["k1"], r["k2"]))
    return train(np.array([np.frombuffer(r["counts"], np.float32) for r in sample], float).reshape(-1, DIMENSIONS), [r["label"] for r in sample])


def predict(model: Model, text: Column) -> Column:
    """Struct (lang, score, rejected) of a text column.

    ``lang`` is the language of the nearest centroid, ``score`` the cosine to it, from 0 to
    1. ``rejected`` is true where the text lies farther from it than nearly all that the
    centroid was fitted on. A null text or one without letters is ``und`` with score 0 and
    rejected, and so is every text if the model knows no language. Of centroids that tie the
    first counts. Long texts are read whole, and a text's result does not depend on other rows.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            if not len(part):
                yield pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))
                continue
            lang, score, rejected = [], [], []
            for texts in _steps(part):
                found = counts(texts)
                known = has_letters(found) & bool(model.languages)
                near = weigh(found, model.idf) @ model.centroids.T if model.languages else np.zeros((len(found), 1))
                best = near.argmax(axis=1)
                cosine = np.clip(near.max(axis=1), 0, 1)
                lang.append(np.where(known, names[model.owner[best]] if model.languages else UNKNOWN, UNKNOWN))
                score.append(np.where(known, cosine, 0.0))
                rejected.append(~known | (cosine < model.radius[best]) if model.languages else ~known)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(lang), pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))], names=["lang", "score", "rejected"])

    return udf(text)
