"""Filters, resampling, joins, aggregates, rankings, samples, splits, metrics, inference and simulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .core import EVER, LAG, Operator, ahead, full, lag, last
from .cross_section import tie_rank


def _op(name: str, stages: tuple, *out: str, mapping: str = "A", plan: Callable[[DataFrame], DataFrame] | None = None) -> Operator:
    return Operator(name, stages, out, mapping, plan)


_DAY = "CAST(floor(t / 24e0) AS BIGINT)"
_RESAMPLE = "SELECT asset, {b} AS t, min_by(open, t) AS open, max(high) AS high, min(low) AS low, max_by(close, t) AS close, floor(sum(volume) * 1000 + 0.5) / 1000 AS volume, count(*) AS members FROM $in GROUP BY asset, {b}"
_GAP = {"prev": lag("t")}
_FLAT = {"flat": "CASE WHEN high = low THEN 1 ELSE 0 END"}
_RUN = {"change": f"CASE WHEN flat <> coalesce({lag('flat')}, -1) THEN 1 ELSE 0 END"}
_RUNS = (_FLAT, _RUN, {"run": f"sum(change) {EVER}"}, {"len": "count(*) OVER (PARTITION BY asset, run)", "stale": "0"})
_SIGNAL = ({"r": f"close / {lag('close')} - 1", "fwd": f"lead(close) {LAG} / close - 1"}, "SELECT asset, t, r AS score, fwd AS actual FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL")
_PROB = (*_SIGNAL, {"p": "1 / (1 + exp(-score))", "y": "CASE WHEN actual > 0 THEN 1 ELSE 0 END"})
#: Shares of the time span at which training and validation end, and the steps of the embargo after each.
TRAIN_SHARE, VAL_SHARE, EMBARGO = 0.65, 0.85, 2
_SPAN = "SELECT min(t) AS first_t, max(t) AS last_t FROM $in"
_BOUNDS = (
    f"SELECT s.*, g.last_t, g.first_t + CAST(floor({TRAIN_SHARE}e0 * (g.last_t - g.first_t)) AS BIGINT) AS train_end, "
    f"g.first_t + CAST(floor({VAL_SHARE}e0 * (g.last_t - g.first_t)) AS BIGINT) AS val_end FROM $in s CROSS JOIN ({_SPAN}) g"
)
_SPLITS = (
    _BOUNDS,
    {"part": f"CASE WHEN t <= train_end THEN 'train' WHEN t <= train_end + {EMBARGO} THEN 'embargo' WHEN t <= val_end THEN 'val' WHEN t <= val_end + {EMBARGO} THEN 'embargo' ELSE 'test' END"},
)
#: A walk-forward schedule: expanding training spans, each followed by a gap and a test span; one fold a row.
_FOLDS = (
    f"SELECT first_t, last_t, CAST(floor(0.4e0 * (last_t - first_t)) AS BIGINT) AS train_span, greatest(CAST(floor(0.1e0 * (last_t - first_t)) AS BIGINT), 1) AS test_span FROM ({_SPAN}) g"
)
_SCHEDULE = (
    f"SELECT fold, first_t, first_t + train_span + (fold - 1) * test_span AS train_stop, first_t + train_span + (fold - 1) * test_span + {EMBARGO} AS test_from, "
    f"first_t + train_span + fold * test_span + {EMBARGO} AS test_stop FROM (SELECT *, SERIES(1, greatest(CAST(floor((last_t + 1 - first_t - train_span - {EMBARGO}) / CAST(test_span AS DOUBLE)) AS INT), 1)) AS fold FROM ({_FOLDS}) f) q"
)
_PANEL = ({"r": f"ln(close) - {lag('ln(close)')}"}, "SELECT * FROM $in WHERE r IS NOT NULL")
_BRACKET = ({"up": f"lead(high) {LAG} / close - 1", "dn": f"1 - lead(low) {LAG} / close", "end_": f"lead(close) {LAG} / close - 1"}, "SELECT * FROM $in WHERE end_ IS NOT NULL", {"dir": "CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END"}, {"fav": "CASE WHEN dir > 0 THEN up ELSE dn END", "adv": "CASE WHEN dir > 0 THEN dn ELSE up END"}, {"lb": "CASE WHEN dir = 0 THEN NULL WHEN adv >= 0.2 THEN -0.2 WHEN fav >= 0.2 THEN 0.2 ELSE dir * end_ END - 0.0014", "ub": "CASE WHEN dir = 0 THEN NULL WHEN fav >= 0.2 THEN 0.2 WHEN adv >= 0.2 THEN -0.2 ELSE dir * end_ END - 0.0014"})


#: The two assets' own rows first: Spark keeps the order of joins, and all assets on a step would meet before.
_PAIRED = _op("JOIN10_paired_inner", ("SELECT a.t, a.close AS x, b.close AS y FROM (SELECT min(asset) AS x, max(asset) AS y FROM $in) p JOIN $in a ON a.asset = p.x JOIN $in b ON b.asset = p.y AND b.t = a.t",), "t", "~x", "~y")


def _hash(*parts: str) -> str:
    """A reproducible pseudorandom number in [0, 1): plain integer arithmetic, so every engine agrees."""
    mixed = " + ".join(f"CAST({p} AS BIGINT) * {m}" for p, m in zip(parts, (7919, 104729, 1299709), strict=False))
    return f"((({mixed}) % 2147483 * 16807 + 12345) % 2147483 * 48271 % 2147483) / 2147483e0"


def _indexed() -> tuple[str, ...]:
    """``i`` and ``n``: each row's place by (t, asset) and the number of rows, from counts a step and places within it."""
    return (
        "SELECT s.*, c.below, c.n FROM $in s JOIN (SELECT t, coalesce(sum(m) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(m) OVER () AS n FROM (SELECT t, count(*) AS m FROM $in GROUP BY t) q) c ON s.t = c.t",
        "SELECT *, below + row_number() OVER (PARTITION BY t ORDER BY asset) AS i FROM $in",
    )


def _cells(x: str, name: str = "") -> tuple[str, ...]:
    """The hundredth of the rows that a value falls in, about, how many rows lie in lower ones, and the number of rows ``n``."""
    return (
        f"SELECT s.*, LEN(KEEP(g.edges; x < s.{x})) AS cell{name} FROM $in s CROSS JOIN (SELECT EDGES({x}) AS edges FROM $in) g",
        f"SELECT s.*, c.below{name}, c.n{name} FROM $in s JOIN (SELECT cell{name}, coalesce(sum(m) OVER (ORDER BY cell{name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below{name}, sum(m) OVER () AS n{name} FROM (SELECT cell{name}, count(*) AS m FROM $in GROUP BY cell{name}) q) c ON s.cell{name} = c.cell{name}",
    )


def _ranked(order: str) -> tuple[str, ...]:
    """``rn`` and ``n``: each row's place in the order (t first within ties) and the number of rows, without one task for all rows."""
    lead_, *ties = [c.strip() for c in order.split(",")]
    return (*_cells(lead_), f"SELECT *, below + row_number() OVER (PARTITION BY cell ORDER BY {', '.join((lead_, 't', *ties))}) AS rn FROM $in")


def _running(x: str) -> tuple:
    """``x_so_far``: the sum of ``x`` up to each row in the order of :func:`_ranked`, from sums a cell and sums within it."""
    return (
        f"SELECT s.*, c.{x}_below FROM $in s JOIN (SELECT cell, coalesce(sum(m) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {x}_below FROM (SELECT cell, sum({x}) AS m FROM $in GROUP BY cell) q) c ON s.cell = c.cell",
        {f"{x}_so_far": f"{x}_below + sum({x}) OVER (PARTITION BY cell ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
    )


def _tied(x: str, name: str) -> tuple:
    """``name``: the average rank of ties over all rows."""
    return (*_cells(x, f"_{name}"), {name: f"below_{name} + rank() OVER (PARTITION BY cell_{name} ORDER BY {x}) + (count(*) OVER (PARTITION BY cell_{name}, {x}) - 1) / 2e0"})


RELATIONAL = [
    # filters and predicates
    _op("FIL01_category_flatten", ("SELECT category, asset FROM (SELECT asset, CASE WHEN CAST(asset AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM $in) c GROUP BY category, asset",), "category", "asset"),
    _op("FIL02_include_filter", ("SELECT a.* FROM $in a WHERE EXISTS (SELECT 1 FROM (SELECT '7' AS name UNION ALL SELECT '11' UNION ALL SELECT 'zz') w WHERE w.name = a.asset)",), "asset", "t", "~close"),
    _op("FIL03_exclude_filter", ("SELECT a.* FROM $in a WHERE NOT EXISTS (SELECT 1 FROM (SELECT ' 7' AS name UNION ALL SELECT '11 ') w WHERE upper(trim(w.name)) = upper(trim(a.asset)))",), "asset", "t", "~close"),
    _op("FIL06_drop_missing", ({"x": f"close / nullif({lag('close')}, 0)"}, "SELECT * FROM $in WHERE x IS NOT NULL"), "asset", "t", "~x"),
    _op("FIL07_compare_filter", ({"natr": "100 * (high - low) / close"}, "SELECT * FROM $in WHERE coalesce(natr > 1, false) AND coalesce(volume BETWEEN 50 AND 500, false)"), "asset", "t", "~natr"),
    _op("FIL08_expression_filter", ("SELECT * FROM $in WHERE (close > open AND trades >= 2) OR volume > 400",), "asset", "t", "trades"),
    _op("FIL10_conjunction", ({"a": "close > open", "b": "trades > 1", "c": "high > low"}, "SELECT * FROM $in WHERE coalesce(a, false) AND coalesce(b, false) AND coalesce(c, false)"), "asset", "t"),
    _op("FIL11_stale_bars", (*_RUNS, {"last_real": "max(CASE WHEN flat = 0 THEN t END) OVER (PARTITION BY asset)"}, {"is_stale": "CASE WHEN (flat = 1 AND len >= 3) OR (t > last_real AND len >= 2) THEN 1 ELSE 0 END"}), "asset", "t", "is_stale"),
    _op("FIL12_stale_horizon", (*_RUNS, {"bad": "CASE WHEN flat = 1 AND len >= 3 THEN 1 ELSE 0 END"}, {"touched": f"greatest(bad, coalesce(max(bad) {ahead(2)}, 0))"}), "asset", "t", "touched"),
    _op("FIL14_stale_threshold", (*_RUNS, "SELECT greatest(CAST(ceil(PCTL(len, 0.99)) AS BIGINT) + 1, 2) AS bars FROM (SELECT asset, run, count(*) AS len FROM $in WHERE flat = 1 GROUP BY asset, run) r"), "bars"),
    _op("FIL15_drop_stale_runs", (*_RUNS, "SELECT * FROM $in WHERE NOT (flat = 1 AND len >= 3)"), "asset", "t", "len"),
    _op("FIL17_dead_tail_trim", ({"real_": "max(CASE WHEN volume > 100 THEN t END) OVER (PARTITION BY asset)"}, "SELECT * FROM $in WHERE t <= real_"), "asset", "t", "~volume"),
    _op("FIL18_universe_mask", ({"pv": lag("volume")}, {"inside": "CASE WHEN pv >= 100 THEN 1 ELSE 0 END", "rk": f"rank() OVER (PARTITION BY t ORDER BY volume DESC, asset)"}, {"big": "CASE WHEN rk <= 50 THEN 1 ELSE 0 END"}), "asset", "t", "inside", "big"),
    _op("FIL22_last_n", ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS k FROM $in) q WHERE k <= 3",), "asset", "t", "k"),
    _op("FIL23_drop_tail", ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS k FROM $in) q WHERE k > 3",), "asset", "t"),
    _op("FIL24_min_length", ({"n": "count(*) OVER (PARTITION BY asset)"}, "SELECT asset, max(n) AS n, CASE WHEN max(n) < 24 THEN 'short' WHEN max(n) < 28 THEN 'thin' ELSE 'ok' END AS status FROM $in GROUP BY asset"), "asset", "n", "status"),
    _op("FIL26_edge_selection", (*_SIGNAL, "SELECT * FROM $in WHERE abs(score) > 0.5"), "asset", "t", "~score"),
    _op("FIL28_skip_reasons", ("SELECT status, count(*) AS assets FROM (SELECT asset, CASE WHEN count(*) < 24 THEN 'short' ELSE 'ok' END AS status FROM $in GROUP BY asset) s GROUP BY status",), "status", "assets"),
    # resampling
    _op("RES01_resample_lenient", (_RESAMPLE.format(b=_DAY),), "asset", "t", "~open", "~high", "~low", "~close", "~volume", mapping="A2"),
    _op("RES02_full_bars", (_RESAMPLE.format(b="CAST(floor(t / 4e0) AS BIGINT)"), "SELECT * FROM $in WHERE members >= 4"), "asset", "t", "~open", "~close", "members", mapping="A2"),
    _op("RES03_all_members", (_RESAMPLE.format(b=_DAY), "SELECT * FROM $in WHERE members = 24"), "asset", "t", "~high", "~low", mapping="A2"),
    _op("RES05_regular_grid", ("SELECT g.asset, g.t, b.close FROM (SELECT a.asset, k.t FROM (SELECT asset, min(t) AS lo, max(t) AS hi FROM $in GROUP BY asset) a JOIN (SELECT DISTINCT t FROM $in) k ON k.t BETWEEN a.lo AND a.hi) g LEFT JOIN $in b ON b.asset = g.asset AND b.t = g.t",), "asset", "t", "~close"),
    _op("RES06_daily_snapshot", (f"SELECT asset, {_DAY} AS day, min_by(close, t) AS snap FROM $in GROUP BY asset, {_DAY}",), "asset", "day", "~snap", mapping="A2"),
    _op("RES07_daily_coverage", (f"SELECT asset, {_DAY} AS day, count(*) / 24e0 AS coverage, CASE WHEN count(*) / 24e0 >= 0.95 THEN sum(volume) END AS v FROM $in GROUP BY asset, {_DAY}",), "asset", "day", "~coverage", "~v", mapping="A2"),
    _op("RES08_grid_ends", ({"rn": f"row_number() {LAG}"}, "SELECT * FROM $in WHERE t % 4 = 0 AND rn >= 8"), "asset", "t", "rn"),
    _op("RES09_group_key", ({"g": "CAST(floor(t / 7e0) AS BIGINT) * 7"}, "SELECT g, count(*) AS n, count(DISTINCT asset) AS assets FROM $in GROUP BY g"), "g", "n", "assets"),
    _op("RES10_holding_stride", ("SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM $in) s", "SELECT t FROM $in WHERE k % 5 = 1"), "t"),
    _op("RES12_calendar_groups", ({"month": "t", "quarter": "CAST(floor(t / 3e0) AS BIGINT)", "year": "CAST(floor(t / 12e0) AS BIGINT) + 1970"}, "SELECT year, quarter, count(*) AS n, max(high) AS hi FROM $in GROUP BY year, quarter"), "year", "quarter", "n", "~hi", mapping="B3"),
    _op("RES13_future_tail", ("SELECT asset, t, close, volume FROM $in UNION ALL SELECT l.asset, l.t + k.k AS t, l.close, 0 AS volume FROM (SELECT asset, max(t) AS t, max_by(close, t) AS close FROM $in GROUP BY asset) l CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k",), "asset", "t", "~close", "~volume"),
    _op("SRC21_gap_scan", (_GAP, "SELECT asset, prev AS gap_start, t AS gap_end, t - prev - 1 AS missing FROM $in WHERE t - prev > 1"), "asset", "gap_start", "gap_end", "missing"),
    _op("SRC22_completeness", (_GAP, "SELECT asset, min(t) AS first_t, max(t) AS last_t, count(*) AS n, PCTL(t - prev, 0.5) AS med, count(CASE WHEN t - prev > 1.5 THEN 1 END) AS gaps, max(t - prev) AS widest FROM $in GROUP BY asset"), "asset", "first_t", "last_t", "n", "~med", "gaps", "widest"),
    _op("SRC23_quality_stats", (_GAP, "SELECT asset, count(*) AS n, count(CASE WHEN t - prev > 1 THEN 1 END) AS gaps, sum(coalesce(t - prev - 1, 0)) AS missing, count(CASE WHEN volume = 0 THEN 1 END) AS idle, count(CASE WHEN NOT (low <= least(open, close) AND greatest(open, close) <= high AND low > 0) THEN 1 END) AS bad FROM $in GROUP BY asset"), "asset", "n", "gaps", "CAST(missing AS BIGINT) AS missing", "idle", "bad"),
    # joins
    _op("JOIN01_asof_closed_bar", (f"SELECT a.asset, a.t, b.close AS day_close FROM $in a LEFT JOIN (SELECT asset, {_DAY} + 1 AS avail, max_by(close, t) AS close FROM $in GROUP BY asset, {_DAY}) b ON a.asset = b.asset AND b.avail = {_DAY.replace('t /', 'a.t /')}",), "asset", "t", "~day_close", mapping="A2"),
    _op("JOIN02_asof_latest", ({"known": "CASE WHEN trades >= 3 THEN close END"}, {"hit": f"max(CASE WHEN known IS NOT NULL THEN t END) {EVER}"}, "SELECT a.asset, a.t, CASE WHEN a.t - a.hit <= 3 THEN b.known END AS v, a.t - a.hit AS age FROM $in a LEFT JOIN $in b ON a.asset = b.asset AND b.t = a.hit"), "asset", "t", "~v", "age"),
    # events of all assets' big bars, aggregated over the steps (t - 6, t] by running sums: an as-of join of two cumulative rows
    _op(
        "JOIN03_range_window",
        (
            "SELECT asset, t, volume AS v, 1 AS n, 0 AS kind FROM $in WHERE trades >= 2 UNION ALL SELECT asset, t, 0, 0, 1 FROM $in UNION ALL SELECT asset, t - 6, 0, 0, 2 FROM $in",
            {"s": "sum(v) OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "c": "sum(n) OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
            "SELECT asset, CASE WHEN kind = 2 THEN t + 6 ELSE t END AS t, max(CASE WHEN kind = 1 THEN s END) - max(CASE WHEN kind = 2 THEN s END) AS s, CAST(max(CASE WHEN kind = 1 THEN c END) - max(CASE WHEN kind = 2 THEN c END) AS BIGINT) AS n FROM $in WHERE kind > 0 GROUP BY asset, CASE WHEN kind = 2 THEN t + 6 ELSE t END",
            {"total": "CASE WHEN n > 0 THEN s END", "mean": "s / nullif(n, 0)"},
        ),
        "asset", "t", "~total", "~mean", "n",
    ),
    _op("JOIN04_daily_to_intraday", (f"SELECT a.asset, a.t, b.v FROM $in a LEFT JOIN (SELECT asset, {_DAY} AS day, sum(volume) AS v FROM $in GROUP BY asset, {_DAY}) b ON a.asset = b.asset AND b.day = CAST(floor(a.t / 24e0) AS BIGINT) - 1",), "asset", "t", "~v", mapping="A2"),
    _op("JOIN05_forward_fill", ("SELECT g.asset, g.t, b.close FROM (SELECT asset, SERIES(lo, hi) AS t FROM (SELECT a.asset, a.lo, m.hi FROM (SELECT asset, min(t) AS lo FROM $in GROUP BY asset) a CROSS JOIN (SELECT max(t) AS hi FROM $in) m) r) g LEFT JOIN $in b ON b.asset = g.asset AND b.t = g.t", {"g": f"count(close) {EVER}"}, {"filled": "max(close) OVER (PARTITION BY asset, g)"}, "SELECT * FROM $in WHERE g > 0"), "asset", "t", "~filled"),
    _op("JOIN06_reindex_fill", ("SELECT a.asset, a.t, coalesce(b.r, 0.5) AS r FROM $in a LEFT JOIN (SELECT asset, t, close / open AS r FROM $in WHERE trades > 1) b ON a.asset = b.asset AND a.t = b.t",), "asset", "t", "~r"),
    _op("JOIN08_contiguous_alignment", ({"back": lag("t", 4)}, "SELECT * FROM $in WHERE t - back = 4"), "asset", "t"),
    _op("JOIN10_paired_inner", ("SELECT a.t, a.close AS x, b.close AS y FROM $in a JOIN $in b ON a.t = b.t JOIN (SELECT min(asset) AS x, max(asset) AS y FROM $in) p ON a.asset = p.x AND b.asset = p.y",), "t", "~x", "~y", plan=_PAIRED),
    _op("JOIN11_baseline_semi", ("SELECT * FROM $in a WHERE EXISTS (SELECT 1 FROM $in b WHERE b.t = a.t AND b.asset = (SELECT min(asset) FROM $in))",), "asset", "t"),
    _op("JOIN12_lookup", ("SELECT a.asset, a.t, coalesce(b.touch, 'amb') AS touch FROM $in a LEFT JOIN (SELECT asset, t, CASE WHEN close > open THEN 'up' ELSE 'down' END AS touch FROM $in WHERE trades > 1) b ON a.asset = b.asset AND a.t = b.t",), "asset", "t", "touch"),
    _op("JOIN13_ledger_merge", (_BOUNDS, "SELECT coalesce(a.t, b.t) AS t, a.c AS old, b.c AS new, CASE WHEN a.c IS NULL THEN 'appended' WHEN b.c IS NULL THEN 'lost' WHEN abs(a.c - b.c) < 0.000001 THEN 'same' ELSE 'changed' END AS state FROM (SELECT t, sum(close) AS c FROM $in WHERE t <= val_end GROUP BY t) a FULL OUTER JOIN (SELECT t, sum(close) AS c FROM $in WHERE t > train_end - 10 GROUP BY t) b ON a.t = b.t",), "t", "~old", "~new", "state"),
    _op("JOIN14_rule_expansion", ("SELECT r.rule, f.asset FROM (SELECT asset, min(t) AS first_t FROM $in GROUP BY asset) f CROSS JOIN (SELECT min(t) AS t0 FROM $in) g JOIN (SELECT 'early' AS rule, 2 AS days UNION ALL SELECT 'late', 5) r ON f.first_t < g.t0 + r.days",), "rule", "asset"),
    # aggregates
    _op("AGG01_daily_summary", ({"day": _DAY, "typ": "(high + low + close) / 3"}, "SELECT asset, day, count(*) AS bars, ln(sum(trades)) AS log_trades, sum(typ * volume) / nullif(sum(volume), 0) AS vwap, max_by(close, t) AS close, max(volume) / nullif(sum(volume), 0) AS top_share FROM $in GROUP BY asset, day", {"vwap_dev": "ln(close / vwap)"}), "asset", "day", "bars", "~log_trades", "~vwap_dev", "~top_share", mapping="A2"),
    _op("AGG02_vwap", ("SELECT asset, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vwap FROM $in GROUP BY asset",), "asset", "~vwap"),
    _op("AGG03_top_k_share", ("SELECT asset, sum(CASE WHEN k <= 4 THEN volume END) / sum(volume) AS share FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY volume DESC, t) AS k FROM $in) q GROUP BY asset",), "asset", "~share"),
    _op("AGG04_hhi", ({"share": "volume / sum(volume) OVER (PARTITION BY asset)"}, "SELECT asset, sum(share * share) AS hhi FROM $in GROUP BY asset"), "asset", "~hhi"),
    _op("AGG05_efficiency_ratio", ({"r": f"ln(close) - {lag('ln(close)')}"}, "SELECT asset, CASE WHEN sum(abs(r)) > 0 THEN least(greatest(abs(sum(r)) / sum(abs(r)), 0), 1) ELSE 0 END AS er FROM $in GROUP BY asset"), "asset", "~er"),
    _op("AGG07_label_balance", (*_PROB, "SELECT count(*) AS n, avg(CAST(y AS DOUBLE)) AS p_up, greatest(avg(CAST(y AS DOUBLE)), 1 - avg(CAST(y AS DOUBLE))) AS majority FROM $in"), "n", "~p_up", "~majority"),
    _op("AGG08_dataset_summary", (*_SIGNAL, "SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi FROM $in"), "n", "~mean", "~sd", "~lo", "~hi"),
    _op("AGG09_missing_report", ({"r": f"close / {lag('close')}", "z": f"close / {lag('close', 5)}"}, "SELECT asset, count(*) AS n, count(CASE WHEN r IS NULL THEN 1 END) AS r_missing, count(CASE WHEN z IS NULL THEN 1 END) AS z_missing FROM $in GROUP BY asset"), "asset", "n", "r_missing", "z_missing"),
    _op("AGG12_crosstab", (*_SIGNAL, {"d": "CASE WHEN score > 0 THEN 'up' ELSE 'down' END"}, "SELECT d, avg(CASE WHEN actual > 0 THEN 1e0 ELSE 0e0 END) AS up, avg(CASE WHEN actual < 0 THEN 1e0 ELSE 0e0 END) AS down, avg(CASE WHEN actual = 0 THEN 1e0 ELSE 0e0 END) AS none FROM $in GROUP BY d"), "d", "~up", "~down", "~none"),
    _op("AGG13_mean_loss", (*_SIGNAL, "SELECT t, count(*) AS n, avg(abs(actual - score)) AS abs_loss, avg((actual - score) * (actual - score)) AS sq_loss FROM $in GROUP BY t"), "t", "n", "~abs_loss", "~sq_loss"),
    _op("AGG14_clustered_t", (*_SIGNAL, {"x": "actual * sign(score)"}, "SELECT s.*, avg(x) OVER () AS m, count(*) OVER () AS total FROM $in s", "SELECT max(total) AS n, max(m) AS mean, sqrt(sum(g * g)) / max(total) AS se FROM (SELECT t, max(total) AS total, max(m) AS m, sum(x) - count(*) * max(m) AS g FROM $in GROUP BY t) q", {"tstat": "mean / se"}), "n", "~mean", "~se", "~tstat"),
    _op("AGG15_t_stat", (*_SIGNAL, "SELECT asset, count(*) AS n, avg(actual) AS mean, avg(actual) / nullif(stddev_samp(actual) / sqrt(count(*)), 0) AS tstat FROM $in GROUP BY asset"), "asset", "n", "~mean", "~tstat"),
    _op("AGG16_bh_q_values", (*_SIGNAL, "SELECT asset, count(*) AS n, 1 / (1 + abs(avg(actual) / nullif(stddev_samp(actual) / sqrt(count(*)), 0))) AS p FROM $in GROUP BY asset", "SELECT * FROM $in WHERE p IS NOT NULL", {"k": "row_number() OVER (ORDER BY p, asset)", "m": "count(*) OVER ()"}, {"q": "least(min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)"}), "asset", "~p", "~q"),
    _op("AGG17_trimmed_mean", (*_SIGNAL, {"k": "row_number() OVER (PARTITION BY asset ORDER BY actual DESC, t)", "n": "count(*) OVER (PARTITION BY asset)"}, "SELECT asset, avg(actual) AS mean FROM $in WHERE k > ceil(n * 0.05e0) GROUP BY asset"), "asset", "~mean"),
    _op("AGG18_event_study", (*_SIGNAL, "SELECT * FROM $in WHERE score < -0.5", "SELECT count(*) AS n, count(DISTINCT t) AS days, avg(actual) * 10000 AS mean_bp, PCTL(actual, 0.5) * 10000 AS median_bp, avg(CASE WHEN actual > 0 THEN 1e0 ELSE 0e0 END) AS win, sum(greatest(actual, 0)) / nullif(-sum(least(actual, 0)), 0) AS pf FROM $in"), "n", "days", "~mean_bp", "~median_bp", "~win", "~pf"),
    _op("AGG19_wilson", (*_SIGNAL, "SELECT asset, count(*) AS n, avg(CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END) AS acc FROM $in GROUP BY asset", {"half": "1.96e0 * sqrt(acc * (1 - acc) / n + 3.8416e0 / (4e0 * n * n)) / (1 + 3.8416e0 / n)", "mid": "(acc + 3.8416e0 / (2e0 * n)) / (1 + 3.8416e0 / n)"}, {"lo": "mid - half", "hi": "mid + half"}), "asset", "n", "~acc", "~lo", "~hi"),
    _op("AGG20_grouping_sets", (*_SIGNAL, {"side": "CASE WHEN score > 0 THEN 'up' ELSE 'down' END"}, "SELECT coalesce(asset, '*') AS asset, coalesce(side, '*') AS side, count(*) AS n, avg(abs(actual)) AS mae FROM $in GROUP BY GROUPING SETS ((asset, side), (side), ())"), "asset", "side", "n", "~mae"),
    _op("AGG22_eta_squared", (*_SIGNAL, {"lvl": "CAST(floor(least(greatest(score, -1), 3) * 2) AS BIGINT)"}, "SELECT s.*, avg(actual) OVER () AS m, avg(actual) OVER (PARTITION BY lvl) AS ml FROM $in s", "SELECT count(DISTINCT lvl) AS levels, sum((ml - m) * (ml - m)) / sum((actual - m) * (actual - m)) AS eta2 FROM $in"), "levels", "~eta2"),
    _op("AGG24_movement_buckets", (*_SIGNAL, {"b": "CASE WHEN abs(score) <= 0.1 THEN 0 WHEN abs(score) <= 0.5 THEN 1 WHEN abs(score) <= 1 THEN 2 ELSE 3 END"}, "SELECT b, count(*) AS n, sum(CASE WHEN score * actual > 0 THEN 1 ELSE 0 END) AS hits FROM $in GROUP BY b"), "b", "n", "CAST(hits AS BIGINT) AS hits"),
    _op("AGG26_batch_drift", (*_SIGNAL, *_indexed(), "SELECT CAST(floor((i - 1) / 200e0) AS BIGINT) AS batch, avg(score) AS m FROM $in GROUP BY 1", {"z": "(m - avg(m) OVER ()) / nullif(stddev_pop(m) OVER (), 0)"}, {"flag": "CASE WHEN abs(z) >= 1.5 THEN 1 ELSE 0 END"}), "batch", "~z", "flag"),
    # rankings
    _op("SRT02_rank_trades", (*_SIGNAL, {"size": "abs(score)"}, *_ranked("size, asset"), {"conf": "(rn - 1) / CAST(n - 1 AS DOUBLE)"}, "SELECT * FROM $in WHERE rn > n - 20", {"k": "row_number() OVER (ORDER BY conf DESC)"}), "asset", "t", "~conf", "k"),
    _op("SRT03_latest_n", ({"k": "row_number() OVER (PARTITION BY asset ORDER BY t DESC)"}, "SELECT * FROM $in WHERE k <= 2"), "asset", "t", "~close"),
    _op("SRT04_leaderboard", (*_SIGNAL, "SELECT asset, count(*) AS n, corr(score, actual) AS ic FROM $in GROUP BY asset HAVING count(*) >= 20", {"k": "row_number() OVER (ORDER BY abs(ic) DESC, asset)"}), "asset", "~ic", "k"),
    _op("SRT06_sealed_order", ("SELECT asset, SHA('salt:' || asset) AS h FROM (SELECT DISTINCT asset FROM $in) a", {"k": "row_number() OVER (ORDER BY h)"}, {"bucket": "(k - 1) % 6"}), "asset", "k", "bucket"),
    # samples
    _op("SMP02_samples", ({"fut_ok": f"lead(t, 3) {LAG} - t", "win_ok": f"t - {lag('t', 7)}", "future_close": f"lead(close, 3) {LAG}", "future_high": f"max(high) {ahead(3)}", "future_low": f"min(low) {ahead(3)}", "mean8": full("avg", "close", 8), "sd8": full("stddev_pop", "close", 8)}, "SELECT * FROM $in WHERE fut_ok = 3 AND win_ok = 7", {"y_high": "CASE WHEN future_high > high THEN 1 ELSE 0 END", "y_low": "CASE WHEN future_low > low THEN 1 ELSE 0 END", "y_close": "CASE WHEN future_close > close THEN 1 ELSE 0 END", "reg_close": "greatest(least((future_close - close) / close, 1), -1)"}), "asset", "t", "y_high", "y_low", "y_close", "~reg_close", "~mean8", "~sd8"),
    _op("SMP03_horizon_contiguity", ({"ahead_t": f"lead(t, 2) {LAG}"}, "SELECT * FROM $in WHERE ahead_t = t + 2"), "asset", "t"),
    _op("SMP04_window_contiguity", ({"back": lag("t", 5)}, "SELECT * FROM $in WHERE t - back = 5"), "asset", "t"),
    _op("SMP06_class_target", ({"f": f"lead(close) {LAG}"}, "SELECT * FROM $in WHERE f IS NOT NULL", {"cls": "CASE WHEN f > close THEN 1 ELSE 0 END"}), "asset", "t", "cls"),
    _op("SMP08_window_scale_target", ({"q1": f"PCTL(close, 0.25) {last(8)}", "q3": f"PCTL(close, 0.75) {last(8)}", "f": f"lead(close) {LAG}", "n": f"count(*) {last(8)}"}, "SELECT * FROM $in WHERE n = 8 AND f IS NOT NULL", {"y": "greatest(least((f - close) / greatest(q3 - q1, 0.00000001), 10), -10)"}), "asset", "t", "~y"),
    _op("SMP11_robust_scale", ({"n": f"count(*) {last(8)}", "center": f"PCTL(close, 0.5) {last(8)}", "q1": f"PCTL(close, 0.25) {last(8)}", "q3": f"PCTL(close, 0.75) {last(8)}"}, "SELECT * FROM $in WHERE n = 8", {"width": "greatest(q3 - q1, 0.001 * abs(center), 0.00000001)"}), "asset", "t", "~center", "~width"),
    _op("SMP18_logret_roundtrip", ({"z": f"(ln(close / {lag('close')}) - 0.01) / 0.5"}, {"back": f"{lag('close')} * exp(z * 0.5 + 0.01) / close"}), "asset", "t", "~z", "~back"),
    _op("SMP22_window_snapshot", ({"n": f"count(*) {last(8)}", "mean": f"avg(close) {last(8)}", "sd": f"stddev_pop(close) {last(8)}", "lo": f"min(close) {last(8)}", "hi": f"max(close) {last(8)}"}, "SELECT * FROM $in WHERE n = 8"), "asset", "t", "~close", "~mean", "~sd", "~lo", "~hi"),
    _op("SPL03_quantile_boundary", ("SELECT PCTL(t, 0.8) AS t1, PCTL(t, 0.9) AS t2 FROM $in",), "~t1", "~t2"),
    _op("SPL04_global_time_split", _SPLITS, "asset", "t", "part"),
    _op("SPL05_per_asset_split", ({"rn": f"row_number() {LAG}", "n": "count(*) OVER (PARTITION BY asset)"}, {"part": "CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' WHEN rn <= floor(n * 0.9e0) THEN 'val' ELSE 'test' END"}), "asset", "t", "part"),
    _op("SPL06_sealed_holdout", (_BOUNDS, "SELECT * FROM $in WHERE t <= val_end"), "asset", "t"),
    _op(
        "SPL07_walk_forward",
        (
            f"SELECT CAST(k.fold AS BIGINT) AS fold, s.asset, s.t, CASE WHEN s.t < k.train_stop THEN 'train' ELSE 'test' END AS part FROM $in s "
            f"JOIN ({_SCHEDULE}) k ON s.t < k.test_stop AND (s.t < k.train_stop OR s.t >= k.test_from)",
        ),
        "fold", "asset", "t", "part",
    ),
    _op("SPL09_min_split_size", (*_SPLITS, "SELECT part, count(*) AS n, CASE WHEN count(*) >= 64 THEN 1 ELSE 0 END AS ok FROM $in GROUP BY part"), "part", "n", "ok"),
    _op("SPL10_purged_kfold", (*_indexed(), {"id": "i - 1", "total": "n"}, "SELECT k.k AS fold, s.asset, s.t, CASE WHEN s.id < k.k * floor(s.total / 6e0) - 10 THEN 'train' ELSE 'val' END AS part FROM $in s JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k ON s.id < k.k * floor(s.total / 6e0) - 10 OR (s.id >= k.k * floor(s.total / 6e0) AND s.id < (k.k + 1) * floor(s.total / 6e0))"), "fold", "asset", "t", "part"),
    # metrics
    _op("MET04_nig_uncertainty", ({"a": "1.5 + trades", "b": "volume + 1", "v": "2 + trades"}, {"aleatoric": "sqrt(b / (a - 1))", "epistemic": "sqrt(b / (v * (a - 1)))"}), "asset", "t", "~aleatoric", "~epistemic"),
    _op("MET05_point_metrics", (*_SIGNAL, "SELECT asset, count(*) AS n, avg(abs(score - actual)) AS mae, avg(CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END) AS direction, corr(score, actual) AS rho FROM $in GROUP BY asset HAVING count(*) > 3"), "asset", "n", "~mae", "~direction", "~rho"),
    _op("MET06_confusion", (*_PROB, {"pred": "CASE WHEN score > 0 THEN 1 ELSE 0 END"}, "SELECT y, pred, count(*) AS n FROM $in GROUP BY y, pred"), "y", "pred", "n"),
    _op("MET07_mae_rmse", (*_SIGNAL, "SELECT count(*) AS n, avg(abs(score - actual)) AS mae, sqrt(avg((score - actual) * (score - actual))) AS rmse, corr(score, actual) AS rho FROM $in"), "n", "~mae", "~rmse", "~rho"),
    _op("MET08_direction_bias", (*_SIGNAL, "SELECT asset, avg(score - actual) AS bias, avg(CASE WHEN sign(score) = sign(actual) THEN 1e0 ELSE 0e0 END) AS same FROM $in GROUP BY asset"), "asset", "~bias", "~same"),
    _op("MET11_flatten", (*_SIGNAL, "SELECT asset, t, 'score' AS target, score AS value FROM $in UNION ALL SELECT asset, t, 'actual' AS target, actual AS value FROM $in"), "asset", "t", "target", "~value"),
    _op("MET12_auc", (*_PROB, *_tied("p", "rk"), "SELECT count(*) AS n, (sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1e0) / 2) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) AS auc FROM $in"), "n", "~auc"),
    _op("MET13_ic", (*_SIGNAL, *_tied("score", "a"), *_tied("actual", "b"), "SELECT count(*) AS n, corr(a, b) AS spearman, corr(score, actual) AS pearson FROM $in"), "n", "~spearman", "~pearson"),
    _op(
        "MET14_decile_spread",
        (
            *_SIGNAL, *_ranked("score, asset"), {"d": "CAST(floor((rn - 1) * 10e0 / n) AS BIGINT)"},
            "SELECT d, count(*) AS n, avg(actual) AS mean, var_samp(actual) AS v FROM $in GROUP BY d",
            {"step": "mean - lag(mean) OVER (ORDER BY d)"},
            "SELECT count(*) AS deciles, max(CASE WHEN d = 9 THEN mean END) - max(CASE WHEN d = 0 THEN mean END) AS spread, CASE WHEN min(step) >= 0 OR max(step) <= 0 THEN 1 ELSE 0 END AS monotonic, "
            "max(CASE WHEN d = 9 THEN v / n END) + max(CASE WHEN d = 0 THEN v / n END) AS var_ FROM $in",
            {"tstat": "CASE WHEN sqrt(var_) > 1e-12 THEN spread / sqrt(var_) ELSE 0 END"},
        ),
        "deciles", "~spread", "monotonic", "~tstat",
    ),
    _op("MET15_window_consistency", (*_SIGNAL, {"w": "CAST(floor(t / 5e0) AS BIGINT)"}, {"a": tie_rank("score", "w"), "b": tie_rank("actual", "w")}, "SELECT w, count(*) AS n, corr(a, b) AS ic FROM $in GROUP BY w", "SELECT count(*) AS windows, avg(ic) AS mean_ic, CASE WHEN min(ic) * max(ic) > 0 THEN 1 ELSE 0 END AS consistent FROM $in"), "windows", "~mean_ic", "consistent"),
    _op(
        "MET17_reliability",
        (
            *_PROB, {"conf": "greatest(p, 1 - p)", "hit": "CASE WHEN (p > 0.5 AND y = 1) OR (p <= 0.5 AND y = 0) THEN 1e0 ELSE 0e0 END"}, *_ranked("conf, asset"), {"b": "CAST(floor((rn - 1) * 10e0 / n) AS BIGINT)"},
            "SELECT b, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc, avg((p - y) * (p - y)) AS brier FROM $in GROUP BY b",
            {"gap": "abs(conf - acc)", "share": "n / sum(n) OVER ()"},
            "SELECT s.b, s.n, s.conf, s.acc, g.ece, g.mce, g.brier FROM $in s CROSS JOIN (SELECT sum(share * gap) AS ece, max(gap) AS mce, sum(share * brier) AS brier FROM $in) g",
        ),
        "b", "n", "~conf", "~acc", "~ece", "~mce", "~brier",
    ),
    _op("MET20_trust_score", (*_PROB, "SELECT 100 * (1 - abs(avg(p) - avg(CAST(y AS DOUBLE)))) * (0.5 + 0.5 * (corr(p, CAST(y AS DOUBLE)) + 1) / 2) AS trust FROM $in"), "~trust"),
    _op("MET22_threshold_pick", (*_SIGNAL, {"hit": "CASE WHEN score * actual < 0 THEN 1e0 ELSE 0e0 END", "weakness": "-abs(score)"}, *_ranked("weakness, asset"), *_running("hit"), {"k": "rn", "acc": "hit_so_far / rn"}, "SELECT max(k) AS k, max(n) AS n, max(k) / CAST(max(n) AS DOUBLE) AS coverage FROM $in WHERE acc >= 0.6 AND k >= 30"), "k", "n", "~coverage"),
    _op("MET28_generalisation_gap", (*_PROB, *_SPLITS, "SELECT part, count(*) AS n, avg(CASE WHEN (score > 0 AND y = 1) OR (score <= 0 AND y = 0) THEN 1e0 ELSE 0e0 END) AS acc FROM $in GROUP BY part"), "part", "n", "~acc"),
    _op("MET35_pinball", (*_SIGNAL, {"d": "actual - score"}, "SELECT avg(greatest(0.1 * d, -0.9 * d)) AS p10, avg(greatest(0.5 * d, -0.5 * d)) AS p50, avg(greatest(0.9 * d, -0.1 * d)) AS p90 FROM $in"), "~p10", "~p50", "~p90"),
    _op("MET44_qlike", ({"v": "high / low", "f": f"avg(high / low) {last(5)}"}, "SELECT asset, avg(v / f - ln(v / f) - 1) AS qlike FROM $in GROUP BY asset"), "asset", "~qlike"),
    # resampling inference
    _op("BST09_newey_west", (*_SIGNAL, "SELECT t, avg(actual) AS x FROM $in GROUP BY t", {"d": "x - avg(x) OVER ()", "n": "count(*) OVER ()", "m": "avg(x) OVER ()"}, {"d1": "lag(d, 1) OVER (ORDER BY t)", "d2": "lag(d, 2) OVER (ORDER BY t)"}, "SELECT max(n) AS n, max(m) AS mean, sqrt(greatest(sum(d * d) + 2 * (2 / 3e0 * sum(d * d1) + 1 / 3e0 * sum(d * d2)), 0)) / max(n) AS se FROM $in"), "n", "~mean", "~se"),
    # simulation
    _op("SIM01_bracket", _BRACKET, "asset", "t", "~lb", "~ub"),
    _op("SIM03_filter_sweep", (*_BRACKET, "SELECT s.*, f.f FROM $in s JOIN (SELECT 'all' AS f UNION ALL SELECT 'busy' UNION ALL SELECT 'long') f ON f.f = 'all' OR (f.f = 'busy' AND s.trades >= 2) OR (f.f = 'long' AND s.dir > 0)", "SELECT f, count(lb) AS n, avg(lb) * 10000 AS lb_bp, avg(ub) * 10000 AS ub_bp, avg(CASE WHEN lb > 0 THEN 1e0 ELSE 0e0 END) AS win FROM $in GROUP BY f"), "f", "n", "~lb_bp", "~ub_bp", "~win"),
    _op("SIM04_reward_risk", (*_BRACKET, {"rr": "CASE WHEN dir = 0 THEN NULL WHEN adv >= 0.1 THEN -1 WHEN fav >= 0.2 THEN 2 ELSE dir * end_ / 0.1 END - 0.014"}), "asset", "t", "~rr"),
    _op("SIM08_trade_metrics", (*_BRACKET, {"x": "lb / 0.2"}, "SELECT count(x) AS n, avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) AS win, avg(x) AS mean, sum(greatest(x, 0)) / nullif(-sum(least(x, 0)), 0) AS pf, PCTL(x, 0.5) AS med FROM $in"), "n", "~win", "~mean", "~pf", "~med"),
    _op("SIM17_tearsheet", (*_SIGNAL, "SELECT t, avg(greatest(actual * sign(score), -1)) AS r FROM $in GROUP BY t", {"e": "exp(sum(ln(1 + r / 10)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"}, {"dd": "e / max(e) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1"}, "SELECT count(*) AS n, avg(r) / nullif(stddev_pop(r), 0) AS sharpe, avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) AS sortino, sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0) AS omega, min(dd) AS max_dd, max_by(e, t) - 1 AS total FROM $in"), "n", "~sharpe", "~sortino", "~omega", "~max_dd", "~total"),
    _op(
        "SIM20_paper_ledger",
        (
            {"r": f"close / {lag('close')} - 1", "fwd": f"lead(close) {LAG} / close - 1"},
            "SELECT t, count(*) AS held, avg(r) AS edge, count(fwd) AS known, avg(fwd) AS ret FROM $in WHERE r > 0.2 GROUP BY t",
            {"before": "lag(held) OVER (ORDER BY t)"},
            {"turnover": "abs(held - coalesce(before, 0)) / CAST(greatest(held, coalesce(before, 0)) AS DOUBLE)", "pnl": "CASE WHEN known = held THEN ret END"},
            {"net": "pnl - 0.0014 * turnover"},
        ),
        "t", "held", "~edge", "~turnover", "~pnl", "~net",
    ),
    _op("SIM21_seasonality", ({"hour": "t % 24", "ret": f"lead(close, 4) {LAG} / close - 1"}, "SELECT hour, count(ret) AS n, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win FROM $in GROUP BY hour"), "hour", "n", "~mean", "~win", mapping="A2"),
    _op("STR08_max_age", ({"hit": f"max(CASE WHEN trades >= 3 THEN t END) {EVER}"}, {"fresh": "CASE WHEN t - hit <= 2 THEN 1 ELSE 0 END"}), "asset", "t", "fresh"),
    _op("SCL01_math", ({"a": "ln(1 + close)", "b": "sqrt(volume)", "c": "sin(close)", "d": "greatest(least(close, 100), 10)"},), "asset", "t", "~a", "~b", "~c", "~d"),
    _op("SCL02_safe_division", ({"x": "coalesce((close - open) / nullif(high - low, 0), 0)"},), "asset", "t", "~x"),
    _op("SCL03_strings", ("SELECT DISTINCT asset, upper(trim(asset || 'usdt')) AS pair, lpad(asset, 6, '0') AS padded FROM $in",), "asset", "pair", "padded"),
    _op("ML09_indicator_survey", ({"a": f"close / {lag('close')}", "b": "0", "c": full("avg", "close", 40)}, "SELECT count(DISTINCT a) AS a_values, count(DISTINCT b) AS b_values, count(c) AS c_known, CASE WHEN count(c) = 0 THEN 'all_null' WHEN count(DISTINCT c) = 1 THEN 'constant' ELSE 'ok' END AS c_status FROM $in"), "a_values", "b_values", "c_known", "c_status"),
    _op("ML12_identity_checks", ("SELECT asset, count(CASE WHEN high < low THEN 1 END) AS hl, count(CASE WHEN open > high OR open < low THEN 1 END) AS o, count(CASE WHEN close > high OR close < low THEN 1 END) AS c FROM $in GROUP BY asset",), "asset", "hl", "o", "c"),
]
