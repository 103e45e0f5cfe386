"""Live and bulk fetchers over any transport: paged series, listings and archive files, with a rate limit.

A transport is a function that a caller supplies, so the engine opens no connection
itself. Fetching runs in tasks, one symbol or file at a time, in pages.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame

#: rows (dicts) of a symbol from a step on, at most so many, in order
Pages = Callable[[str, int, int], list[dict]]
#: a file's rows, or None where there is no such file
Files = Callable[[str, str], list[dict] | None]


class RateLimiter:
    """At most ``calls`` in any ``period`` seconds; threads share it."""

    def __init__(self, calls: int, period: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.period, self.clock, self.sleep = calls, period, clock, sleep
        self._made: deque[float] = deque()
        self._lock = Lock()

    def wait(self) -> float:
        """Block until a call is allowed; returns its time."""
        with self._lock:
            now = self.clock()
            if len(self._made) >= self.calls:
                free = self._made[0] + self.period
                if free > now:
                    self.sleep(free - now)
                    now = max(self.clock(), free)
                self._made.popleft()
            self._made.append(now)
            return now


def pages(get: Pages, symbol: str, start: int, end: int, limit: int, key: str = "t", limiter: RateLimiter | None = None) -> Iterator[list[dict]]:
    """Pages of a symbol's rows from ``start`` up to ``end``; a short or empty page, or one that does not move on, is the last."""
    at = start
    while at <= end:
        if limiter:
            limiter.wait()
        page = get(symbol, at, limit)
        kept = [r for r in page if at <= r[key] <= end]
        if kept:
            yield kept
        if len(page) < limit or not kept:
            return
        at = max(r[key] for r in kept) + 1


def fetch(symbols: DataFrame, get: Pages, schema: str, *, start: int, end: int, limit: int = 1000, tasks: int = 8, calls: int = 20, period: float = 1.0) -> DataFrame:
    """Rows (symbol, ...) of every symbol of a frame (symbol, optionally ``from_t`` to resume); the rate is shared out over the tasks."""
    columns = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(max(1, calls // tasks), period)
        for batch in batches:
            first = batch["from_t"] if "from_t" in batch else [start] * len(batch)
            for symbol, at in zip(batch["symbol"], first, strict=True):
                for page in pages(get, symbol, int(at), end, limit, limiter=limiter):
                    yield pd.DataFrame(page).assign(symbol=symbol)[["symbol", *columns]]

    return symbols.repartition(tasks, "symbol").mapInPandas(run, f"symbol string, {schema}")


def fetch_files(files: DataFrame, get: Files, schema: str, *, tasks: int = 8) -> DataFrame:
    """Rows of archive files (symbol, period); one that does not exist gives none."""
    columns = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, period in zip(batch["symbol"], batch["period"], strict=True):
                if rows := get(symbol, period):
                    yield pd.DataFrame(rows).assign(symbol=symbol, period=period)[["symbol", "period", *columns]]

    return files.repartition(tasks, "symbol", "period").mapInPandas(run, f"symbol string, period string, {schema}")


def listing(spark, get: Callable[[], list[dict]], *, quote: str = "USDT", status: str = "TRADING") -> DataFrame:
    """(symbol, base) of the listed symbols with a quote currency and status."""
    rows = [(r["symbol"], r["symbol"].removesuffix(quote)) for r in get() if r["symbol"].endswith(quote) and r.get("status") == status]
    return spark.createDataFrame(sorted(rows), "symbol string, base string")
