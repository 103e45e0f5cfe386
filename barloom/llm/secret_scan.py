"""Secret scans: fixed patterns, then corpus-wide ownership of the values found.

Every candidate value is hashed and counted over distinct owners and
repositories of the whole corpus. A value that many owners hold in many
repositories is a copied example; one that few owners hold, in however many
repositories of theirs, looks live. Patterns of the base kinds
always stay; free tokens (kind ``owned``) are reported only if they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, hashes, join_sized, unused

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "owned")
#: A value that this many distinct owners hold in this many repositories is a widely copied example.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 3
OWNED_CHARS = 20
OWNED_BITS = 3.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_OWNED = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % OWNED_CHARS)
_WORDS = ("password", "passwd", "secret", "token", "api")
_STEP_BYTES = 8 << 20
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
_SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:int,start:int,end:int,value:string>>"


def bits(token: str) -> float:
    """Shannon entropy of a token's characters, in bits each."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base patterns, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # most texts name no secret at all
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def owned_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Free tokens of mixed characters and high entropy that no base span touches."""
    out = []
    for m in _OWNED.finditer(text):
        t = m[0]
        if re.search("[a-z]", t) and re.search("[A-Z]", t) and re.search("[0-9]", t) and bits(t) >= OWNED_BITS and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            out.append((3, m.start(), m.end(), t))
    return out


def label(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, "text", _STEP_BYTES):
        found = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            count = Counter(s[0] for s in base)
            spans = [(k, s, e, hashlib.sha256(v.encode()).hexdigest()) for k, s, e, v in base + owned_candidates(text, base)]
            found.append((count[0], count[1], count[2], hashlib.sha256(label(base).encode()).hexdigest(), [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in spans]))
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "k1", "k2", "owner", "repository")), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.list_(_SPAN))],
            names=["doc_id", "k1", "k2", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def _named(column: Column | str) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: Column | str = "source", repository: Column | str = "source", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans with their ownership.

    ``owner`` and ``repository`` are columns or expressions; a table with a single key of
    origin can give it for both. Columns: doc_id, k1, k2 (the row's key), n_assign, n_access,
    n_hex, base_sha256, found (array of start, kind, end, live: sorted by start, then kind),
    n_live and n_copied (spans whose value is owner-specific or widely copied).

    A null or empty text has no spans; a null owner or repository counts as one of its own;
    repeated rows each get the same result and count as one holder. Values that tie with
    the bounds are copied. Long texts are scanned whole; an empty table gives no rows.
    """
    k1, k2 = hashes(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), _named(owner).alias("owner"), _named(repository).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = cut(rows.mapInArrow(_scan, f"doc_id long, k1 long, k2 long, owner string, repository string, {_SCANNED}"))
    spans = scanned.select("k1", "k2", "owner", "repository", F.explode("spans").alias("s")).select("k1", "k2", "owner", "repository", "s.*")
    # one row per value and holder first: a value that a third of all documents copy is pre-aggregated map-side
    held = spans.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    held = cut(held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("n").alias("rows")))
    known = spans.groupBy("k1", "k2", "kind", "start", "end", "value").agg(F.count(F.lit(1)).alias("n"))
    live = (F.col("owners") < wide_owners) | (F.col("repositories") < wide_repositories)
    judged = join_sized(known, held, ["value"], "rows", held.agg(F.sum("rows")).first()[0] or 0).withColumn("live", live)
    found = judged.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end", "live")))).alias("found"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,live:boolean>>)")
    return scanned.drop("spans", "owner", "repository").join(found, ["k1", "k2"], "left").withColumns({"found": F.coalesce("found", none), "n_live": F.coalesce("n_live", F.lit(0)), "n_copied": F.coalesce("n_copied", F.lit(0))})


def span_label(found: str = "found") -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """The same documents with every reported span replaced by ``mark``; columns and rows stay.

    Overlapping spans become one mark. n_chars, where the table has it, follows the new text.
    Null and empty texts and an empty table stay as they are; see :func:`scan_secrets`.
    """
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    found, a_, b_ = (unused(name, docs) for name in ("found", "k1", "k2"))
    # one entry for each key, so that repeated rows do not multiply
    hits = scan_secrets(docs, **options).where(F.size("found") > 0).groupBy(F.col("k1").alias(a_), F.col("k2").alias(b_)).agg(F.first("found").alias(found))
    steps = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["done"], F.when(s["start"] < a["at"], F.lit("")).otherwise(F.concat(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).alias("done"),
        ),
        lambda a: F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))),
    )
    k1, k2 = hashes(doc_id, text)
    joined = docs.withColumns({a_: k1, b_: k2}).join(hits, [a_, b_], "left")
    clean = F.when(F.col(found).isNull(), F.col(text)).otherwise(steps)
    columns = [clean.alias(c) if c == text else F.length(clean).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns)
