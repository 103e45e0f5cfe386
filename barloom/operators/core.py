"""Operators over bar frames as declarative plans.

An operator is a chain of stages; each adds columns by SQL expressions (or is a
whole statement), so Catalyst sees one plan and shares sorts and exchanges over
equal window specifications. The same text, translated by
:mod:`barloom.sources.dialect`, is the oracle that DuckDB runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.dialect import to_duckdb, to_spark

LAG = "OVER (PARTITION BY asset ORDER BY t)"
EVER = "OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ACROSS = "OVER (PARTITION BY t)"


def last(n: int) -> str:
    """The frame of this row and the n - 1 before it."""
    return f"OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    """The n rows before this one."""
    return f"OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def ahead(n: int) -> str:
    """The n rows after this one."""
    return f"OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(function: str, x: str, n: int, frame: str | None = None) -> str:
    """An aggregate over a frame that is null unless all n values are known."""
    over = frame or last(n)
    return f"CASE WHEN count({x}) {over} = {n} THEN {function}({x}) {over} END"


def full2(function: str, x: str, y: str, n: int) -> str:
    """As :func:`full` for an aggregate of two columns."""
    return f"CASE WHEN count(({x}) + ({y})) {last(n)} = {n} THEN {function}({x}, {y}) {last(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {LAG}"


def rounded(x: str) -> str:
    """To 6 places by the same floating-point steps in every engine: round() breaks ties differently."""
    return f"CAST(floor(CAST({x} AS DOUBLE) * 1000000 + 0.5) AS DOUBLE) / 1000000"


@dataclass(frozen=True)
class Operator:
    """``stages``: dicts of column -> expression, or statements that read ``$in``; ``out``: result columns, ``~`` marks doubles to round.

    ``plan``: how Spark gets the same result, where the stages as they stand would make too many rows on the way.
    """

    name: str
    stages: tuple
    out: tuple[str, ...]
    mapping: str = "B2"
    plan: Callable[[DataFrame], DataFrame] | None = None

    def sql(self, source: str) -> str:
        parts, at = [f"s0 AS (SELECT * FROM {source})"], 0
        for stage in self.stages:
            body = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM s{at}" if isinstance(stage, dict) else stage.replace("$in", f"s{at}")
            at += 1
            parts.append(f"s{at} AS ({body})")
        columns = ", ".join(f"{rounded(c[1:])} AS {c[1:]}" if c[0] == "~" else c for c in self.out)
        return f"WITH {', '.join(parts)} SELECT {columns} FROM s{at}"

    def __call__(self, frame: DataFrame) -> DataFrame:
        return self.plan(frame) if self.plan else frame.sparkSession.sql(to_spark(self.sql("{frame}")), frame=frame)

    def oracle(self, source: str) -> str:
        return to_duckdb(self.sql(f"({source}) bars"))
