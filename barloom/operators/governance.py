"""Targets, work splits, sealed buckets, access records, touched data, run contracts and profiles.

These work on names and settings, which are small; rows stay where they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import resource
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import present
from ..sources.sinks import read_json, write_json

BUCKETS = ("H1", "H2", "H3", "H4", "H5", "H6")
SEALED_SHARE = 0.4
#: The bucket that takes no asset whose derivative data were touched.
UNTOUCHED = "H3"


@dataclass(frozen=True)
class Target:
    """What is predicted: a price or another quantity, continuous or in classes."""

    name: str
    kind: str = "continuous"
    classes: tuple[str, ...] = ()
    scale: float = 1.0
    relative_to_entry: bool = True


PRICES = {n: Target(n) for n in ("high", "low", "close")}


def _items(asked) -> Iterable:
    if asked is None:
        return
    if isinstance(asked, str):
        yield from re.split(r"[,\s]+", asked.strip())
    elif isinstance(asked, (Target, dict)):
        yield asked
    else:
        for a in asked:
            yield from _items(a)


def resolve_targets(asked=None, available: Iterable[str] | None = None) -> list[Target]:
    """Names, lists, dicts and targets in one list: in order, each name once.

    Nothing or 'all' is all that the model gives, else the three prices. An unknown name is
    an error unless the model gives it; then it is continuous and has no entry price.
    """
    given = None if available is None else [a.strip().lower() for a in available]
    items = [i for i in _items(asked) if i != ""]
    every = not items or any(isinstance(i, str) and i.lower() == "all" for i in items)
    items = [i for i in items if not (isinstance(i, str) and i.lower() == "all")]
    out: dict[str, Target] = {}
    for item in [*items, *((given or list(PRICES)) if every else [])]:
        if isinstance(item, str):
            name = item.lower()
            if name not in PRICES and name not in (given or []):
                raise ValueError(f"no target {item!r}; known: {', '.join(PRICES)}")
            item = PRICES.get(name) or replace(Target(name), relative_to_entry=False)
        elif isinstance(item, dict):
            item = Target(**item)
        out.setdefault(item.name, item)
    if given is not None and (missing := [n for n in out if n not in given]):
        raise ValueError(f"the model does not give {', '.join(missing)}")
    return list(out.values())


def split_work(costs: dict[str, float], workers: int) -> dict[str, int]:
    """Items over workers, dearest first, each to the one with least to do; ties go by name and number."""
    load, out = [0.0] * workers, {}
    for name in sorted(costs, key=lambda n: (-costs[n], n)):
        out[name] = min(range(workers), key=lambda w: (load[w], w))
        load[out[name]] += costs[name]
    return out


def sealed_buckets(eligible: DataFrame, salt: str) -> DataFrame:
    """(asset, bucket, moved) of the sealed share of assets (asset, derived), in the order of their salted hashes.

    Buckets take turns; where the untouched bucket refuses an asset, the emptiest other one
    takes it. Assets are names of an exchange, some thousands, and are dealt in the driver.
    """
    rows = sorted((r.asset, bool(r.derived)) for r in eligible.select("asset", "derived").collect())
    rows.sort(key=lambda r: (hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[0]))
    held, out = dict.fromkeys(BUCKETS, 0), []
    for i, (asset, derived) in enumerate(rows[: math.ceil(SEALED_SHARE * len(rows))]):
        bucket = BUCKETS[i % len(BUCKETS)]
        moved = bucket == UNTOUCHED and derived
        if moved:
            bucket = min((b for b in BUCKETS if b != UNTOUCHED), key=lambda b: (held[b], b))
        held[bucket] += 1
        out.append((asset, bucket, moved))
    return eligible.sparkSession.createDataFrame(out, "asset string, bucket string, moved boolean")


def open_bucket(spark: SparkSession, log: str, buckets: dict[str, list[str]], bucket: str, card: dict) -> list[str]:
    """The assets of a sealed bucket, once: the card must confirm and name its frozen rules, and the opening is recorded."""
    if not buckets.get(bucket):
        raise PermissionError("unknown bucket")
    if str(card.get("confirmation", "")).lower() != "true":
        raise PermissionError("not confirmed")
    if not re.fullmatch("[0-9a-f]{64}", card.get("frozen_rules_sha256", "")):
        raise PermissionError("no frozen rules")
    opened = read_json(spark, log) if present(spark, {"": log})[""] else {}
    if bucket in opened:
        raise PermissionError("already opened")
    write_json(spark, log, opened | {bucket: card["frozen_rules_sha256"]})
    return buckets[bucket]


def try_open(spark: SparkSession, log: str, buckets: dict[str, list[str]], bucket: str, card: dict) -> str:
    """'opened' or why not."""
    try:
        open_bucket(spark, log, buckets, bucket, card)
        return "opened"
    except PermissionError as error:
        return str(error)


def touched(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(asset, rules): the rules, as conditions on rows, that each asset's data fell under; assets under none are left out."""
    hit = F.array_compact(F.array(*[F.max(F.when(c, name)) for name, c in sorted(rules.items())]))
    return rows.groupBy("asset").agg(F.array_join(hit, ",").alias("rules")).where("rules <> ''")


def validate_outputs(spark: SparkSession, root: str, contract: dict[str, str]) -> DataFrame:
    """(output, state) of a run's listed files: 'ok' by their SHA-256, 'changed' or 'missing'."""
    there = present(spark, {name: f"{root}/{name}" for name in contract})
    found = {}
    if known := [f"{root}/{n}" for n in contract if there[n]]:
        hashed = spark.read.format("binaryFile").load(known).select(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256))
        found = {r[0]: r[1] for r in hashed.collect()}
    state = [(n, "missing" if not there[n] else "ok" if found.get(n) == digest else "changed") for n, digest in contract.items()]
    return spark.createDataFrame(state, "output string, state string")


def profile(spark: SparkSession, steps: dict[str, Callable[[], int]]) -> DataFrame:
    """(step, rows, seconds, memory_mb) of steps run in order; each returns its number of rows."""
    out = []
    for name, run in steps.items():
        start = time.perf_counter()
        rows = run()
        out.append((name, rows, time.perf_counter() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))
    return spark.createDataFrame(out, "step string, rows long, seconds double, memory_mb double")
