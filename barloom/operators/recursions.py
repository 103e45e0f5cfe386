"""Recursive scans: a state that runs through each asset's bars in order.

In Spark the scan is the native ``aggregate`` over an asset's sorted rows, so it
stays in the JVM. Appending copies an array, so states gather in blocks of
:data:`BLOCK` rows, each starting from the last state of the block before: n rows
cost n * BLOCK + (n / BLOCK)^2 copied references instead of n^2. The oracle steps
through a recursive CTE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.dialect import to_duckdb, to_spark
from .core import Operator, full, lag

#: Rows of a series that are folded into one array of states.
BLOCK = 256


@dataclass(frozen=True)
class Scan:
    """``state``: name -> (first value, step); a step reads the state before as s.name and the row as r.column.

    ``after``: stages over the states, whose columns ``out`` names then.
    """

    name: str
    stages: tuple
    inputs: tuple[str, ...]
    state: dict[str, tuple[str, str]]
    out: tuple[str, ...]
    mapping: str = "B3"
    after: tuple = ()

    def _finish(self, source: str) -> str:
        return Operator("", self.after, ("asset", "t", *[f"~{c}" for c in self.out])).sql(source)

    def _prepared(self, source: str) -> str:
        columns = ("asset", "t", *self.inputs)
        return Operator("", self.stages, columns).sql(source)

    def __call__(self, frame: DataFrame) -> DataFrame:
        spark = frame.sparkSession
        rows = spark.sql(to_spark(self._prepared("{frame}")), frame=frame)
        first = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, (v, _) in self.state.items())
        step = ", ".join(f"'{k}', CAST({re.sub(r'\bs\.', 'element_at(o, -1).', e)} AS DOUBLE)" for k, (_, e) in self.state.items())
        inner = f"aggregate(block, slice(element_at(done, -1), -1, 1), (o, r) -> array_append(o, named_struct('t', r.t, {step})))"
        blocks = f"transform(sequence(0, (size(rows) - 1) div {BLOCK}), i -> slice(rows, i * {BLOCK} + 1, {BLOCK}))"
        fold = f"aggregate({blocks}, array(array(named_struct('t', CAST(NULL AS BIGINT), {first}))), (done, block) -> array_append(done, {inner}))"
        states = f"flatten(transform(slice({fold}, 2, size(rows)), b -> slice(b, 2, {BLOCK})))"
        found = spark.sql(f"SELECT asset, inline({states}) FROM (SELECT asset, array_sort(collect_list(struct(t, {', '.join(self.inputs)}))) AS rows FROM {{rows}} GROUP BY asset)", rows=rows)
        return spark.sql(to_spark(self._finish("{found}")), found=found)

    def oracle(self, source: str) -> str:
        rows = to_duckdb(self._prepared(f"({source}) bars"))
        first = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, (v, _) in self.state.items())
        step = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, (_, e) in self.state.items())
        states = f"""WITH RECURSIVE p AS ({rows}), n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS rn FROM p),
            f AS (SELECT DISTINCT asset, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS t, {first} FROM n UNION ALL
                  SELECT r.asset, r.rn, r.t, {step} FROM f s JOIN n r ON r.asset = s.asset AND r.rn = s.rn + 1)
            SELECT asset, t, {', '.join(self.state)} FROM f WHERE rn > 0"""
        return to_duckdb(self._finish(f"({states}) states"))


def ema(x: str, name: str, span: int) -> str:
    """Exponential mean seeded with the first value."""
    return f"CASE WHEN s.{name} IS NULL THEN {x} ELSE s.{name} + {2 / (span + 1)!r} * ({x} - s.{name}) END"


def alpha(x: str, name: str, n: int) -> str:
    """Exponential mean of weight 1/n that skips nulls, seeded with the first value."""
    return f"CASE WHEN {x} IS NULL THEN s.{name} WHEN s.{name} IS NULL THEN {x} ELSE s.{name} + ({x} - s.{name}) / {float(n)!r} END"


def wilder(x: str, name: str, n: int) -> dict[str, tuple[str, str]]:
    """Wilder smoothing: the mean of the first n values, then weight 1/n; a gap after the seed ends it."""
    count, total = f"{name}_n", f"{name}_sum"
    return {
        count: ("0", f"CASE WHEN s.{count} < 0 THEN -1 WHEN {x} IS NULL THEN CASE WHEN s.{count} = 0 THEN 0 ELSE -1 END ELSE least(s.{count} + 1, {n}) END"),
        total: ("0", f"CASE WHEN {x} IS NULL THEN s.{total} WHEN s.{count} < {n} THEN s.{total} + {x} ELSE s.{total} END"),
        name: ("NULL", f"CASE WHEN {x} IS NULL OR s.{count} < 0 THEN NULL WHEN s.{count} + 1 = {n} AND s.{name} IS NULL THEN (s.{total} + {x}) / {float(n)!r} WHEN s.{name} IS NOT NULL THEN s.{name} + ({x} - s.{name}) / {float(n)!r} END"),
    }


_CHANGE = {"rsi": "100 * u / nullif(u + d, 0)"}, {"dp": f"lc - {lag('lc', 5)}", "dr": f"rsi - {lag('rsi', 5)}"}
_DIVERGENCE = {"div": "coalesce(" + " - ".join(f"({x} - {full('avg', x, 20)}) / nullif({full('stddev_samp', x, 20)}, 0)" for x in ("dp", "dr")) + ", 0)"}
_CLOSE = ({"c": "close"},)
_MOVE = ({"d": f"close - {lag('close')}"}, {"up": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", "dn": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END"})
_BAR = ({"pc": lag("close"), "ph": lag("high"), "pl": lag("low")}, {"tr": "CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", "um": "high - ph", "dm": "pl - low"}, {"pdm": "CASE WHEN um IS NULL THEN NULL WHEN um > dm AND um > 0 THEN um ELSE 0 END", "mdm": "CASE WHEN dm IS NULL THEN NULL WHEN dm > um AND dm > 0 THEN dm ELSE 0 END"})
_FAST, _SLOW = ema("r.c", "fast", 12), ema("r.c", "slow", 26)
_LINE = f"(({_FAST}) - ({_SLOW}))"
_PDI = alpha("r.pdm", "pdm", 14)
_MDI = alpha("r.mdm", "mdm", 14)
_DX = f"(100 * abs(({_PDI}) - ({_MDI})) / nullif(({_PDI}) + ({_MDI}), 0))"
_RSV = "(100 * (r.close - r.ll) / nullif(r.hh - r.ll, 0))"
_K = f"CASE WHEN {_RSV} IS NULL THEN NULL ELSE coalesce(s.k, 50) * 2 / 3 + {_RSV} / 3 END"
_SAR_FLIP = "((s.dir > 0 AND r.low < s.sar + s.af * (s.ep - s.sar)) OR (s.dir < 0 AND r.high > s.sar + s.af * (s.ep - s.sar)))"
_UPPER = "CASE WHEN r.ub IS NULL THEN s.fu WHEN s.fu IS NULL OR r.ub < s.fu OR r.pc > s.fu THEN r.ub ELSE s.fu END"
_LOWER = "CASE WHEN r.lb IS NULL THEN s.fl WHEN s.fl IS NULL OR r.lb > s.fl OR r.pc < s.fl THEN r.lb ELSE s.fl END"
_TREND = "CASE WHEN s.fu IS NOT NULL AND r.close > s.fu THEN 1 WHEN s.fl IS NOT NULL AND r.close < s.fl THEN -1 ELSE s.trend END"
_MEAN_TR = ({"pc": lag("close")}, {"tr": "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))"}, {"atr": "CASE WHEN count(tr) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN avg(tr) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END"}, {"ub": "(high + low) / 2 + 3 * atr", "lb": "(high + low) / 2 - 3 * atr"})
_SUPER = {"fu": ("NULL", _UPPER), "fl": ("NULL", _LOWER), "trend": ("1", _TREND)}
_SAR = {
    "n": ("0", "s.n + 1"),
    "dir": ("1", f"CASE WHEN s.n = 0 THEN 1 WHEN {_SAR_FLIP} THEN -s.dir ELSE s.dir END"),
    "sar": ("NULL", f"CASE WHEN s.n = 0 THEN r.low WHEN {_SAR_FLIP} THEN s.ep ELSE s.sar + s.af * (s.ep - s.sar) END"),
    "ep": ("NULL", f"CASE WHEN s.n = 0 THEN r.high WHEN {_SAR_FLIP} THEN CASE WHEN s.dir > 0 THEN r.low ELSE r.high END WHEN s.dir > 0 THEN greatest(s.ep, r.high) ELSE least(s.ep, r.low) END"),
    "af": ("0.02", f"CASE WHEN s.n = 0 OR {_SAR_FLIP} THEN 0.02 WHEN (s.dir > 0 AND r.high > s.ep) OR (s.dir < 0 AND r.low < s.ep) THEN least(s.af + 0.02, 0.2) ELSE s.af END"),
}

RECURSIONS = [
    Scan("REC01_ema", _CLOSE, ("c",), {"ema": ("NULL", ema("r.c", "ema", 20))}, ("ema",)),
    Scan("REC02_ewm_alpha", _MOVE, ("up", "dn"), {"u": ("NULL", alpha("r.up", "u", 14)), "d": ("NULL", alpha("r.dn", "d", 14))}, ("u", "d")),
    Scan("REC03_wilder", _BAR, ("tr",), wilder("r.tr", "atr", 14), ("atr",)),
    Scan("REC04_natr", _BAR, ("tr", "close"), {"seen": ("0", "s.seen + CASE WHEN r.tr IS NULL THEN 0 ELSE 1 END"), "atr": ("NULL", alpha("r.tr", "atr", 14)), "natr": ("NULL", f"CASE WHEN s.seen + 1 >= 14 THEN 100 * ({alpha('r.tr', 'atr', 14)}) / r.close END")}, ("natr",)),
    Scan("REC05_rsi", _MOVE, ("up", "dn"), {**wilder("r.up", "u", 14), **wilder("r.dn", "d", 14)}, ("u", "d")),
    Scan("WIN18_rsi_divergence", (*_MOVE, {"logc": "ln(close)"}), ("up", "dn", "logc"), {**wilder("r.up", "u", 14), **wilder("r.dn", "d", 14), "lc": ("NULL", "r.logc")}, ("rsi", "div"), "B2", (*_CHANGE, _DIVERGENCE)),
    Scan("REC06_macd", _CLOSE, ("c",), {"fast": ("NULL", _FAST), "slow": ("NULL", _SLOW), "line": ("NULL", _LINE), "signal": ("NULL", ema(_LINE, "signal", 9))}, ("line", "signal")),
    Scan("REC07_kdj", ({"hh": "max(high) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)", "ll": "min(low) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"},), ("close", "hh", "ll"), {"k": ("NULL", _K), "d": ("NULL", f"CASE WHEN ({_K}) IS NULL THEN NULL ELSE coalesce(s.d, 50) * 2 / 3 + ({_K}) / 3 END")}, ("k", "d")),
    Scan("REC08_parabolic_sar", (), ("high", "low"), _SAR, ("sar", "dir")),
    Scan("REC09_adx", _BAR, ("tr", "pdm", "mdm"), {"tr": ("NULL", alpha("r.tr", "tr", 14)), "pdm": ("NULL", _PDI), "mdm": ("NULL", _MDI), "adx": ("NULL", alpha(_DX, "adx", 14))}, ("tr", "pdm", "mdm", "adx")),
    Scan("REC10_supertrend", _MEAN_TR, ("close", "pc", "ub", "lb"), _SUPER, ("trend", "fu", "fl")),
    Scan("REC11_supertrend_stretch", _MEAN_TR, ("close", "pc", "ub", "lb"), {**_SUPER, "stretch": ("NULL", f"100 * (r.close - CASE WHEN ({_TREND}) > 0 THEN ({_LOWER}) ELSE ({_UPPER}) END) / r.close")}, ("trend", "stretch")),
    Scan("REC12_psar_direction", (), ("high", "low", "close"), {**_SAR, "feature": ("0", f"CASE WHEN s.n = 0 THEN 0 WHEN {_SAR_FLIP} THEN -s.dir ELSE s.dir END")}, ("feature",)),
    Scan("REC15_equity_fractional", ({"x": f"greatest(coalesce(100 * (close / {lag('close')} - 1), 0), -100)"},), ("x",), {"equity": ("1", "s.equity * (1 + 0.01 * r.x / 100)")}, ("equity",)),
    Scan("FIL19_event_cooldown", ({"event": f"CASE WHEN close < {lag('close')} * 0.8 THEN 1 ELSE 0 END"},), ("event",), {"wait": ("0", "CASE WHEN r.event = 1 AND s.wait <= 0 THEN 5 ELSE greatest(s.wait - 1, 0) END"), "kept": ("0", "CASE WHEN r.event = 1 AND s.wait <= 0 THEN 1 ELSE 0 END")}, ("kept",)),
    Scan("FIL20_stride_thinning", ({"rn": "row_number() OVER (PARTITION BY asset ORDER BY t)"}, {"grid": "CASE WHEN t % 2 = 0 THEN 1 ELSE 0 END"}), ("rn", "grid"), {"last": ("-1000", "CASE WHEN r.grid = 1 AND r.rn - s.last >= 3 THEN r.rn ELSE s.last END"), "kept": ("0", "CASE WHEN r.grid = 1 AND r.rn - s.last >= 3 THEN 1 ELSE 0 END")}, ("kept",)),
]
