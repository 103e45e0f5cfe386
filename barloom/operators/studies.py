"""Study operators: schedules, calibration, quantile fits, block bootstraps, path simulation, candidate scans and scores.

Bootstraps first reduce to one row a step, so replicas multiply steps and not rows.
"""

from __future__ import annotations

from .core import ACROSS, LAG, full, lag, last, prior
from .cross_section import spearman, tie_rank
from .evaluation import _scalar
from .recursions import Scan, ema
from .relational import _BOUNDS, _BRACKET, _PROB, _RESAMPLE, _SIGNAL, _SPAN, _SPLITS, _hash, _op


def _union(rows: str, *columns: str) -> str:
    """A literal table: rows are separated by ';', values by '|'."""
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v.strip()} AS {c}" for v, c in zip(r.split("|"), columns, strict=True)) for r in rows.split(";"))


def _auc(y: str = "y", rank: str = "rk") -> str:
    return f"(sum(CASE WHEN {y} = 1 THEN {rank} ELSE 0e0 END) - sum({y}) * (sum({y}) + 1e0) / 2) / nullif(sum({y}) * CAST(sum(1 - {y}) AS DOUBLE), 0)"


def _melt(keys: str, names: tuple[str, ...], where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS name, CAST({n} AS DOUBLE) AS x FROM $in{where}" for n in names)


_RANGE = ({"x": "close", "y": f"lead(high - low) {LAG}"}, "SELECT * FROM $in WHERE x > 0 AND y > 0", {"lx": "ln(x)", "ly": "ln(y)"})
_BINS = "SELECT b, part, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s, avg(p) AS p, avg((p - y) * (p - y)) AS brier FROM $in GROUP BY b, part"
_BINNED = (*_PROB, _BOUNDS, {"part": "CASE WHEN t <= train_end THEN 'val' ELSE 'test' END", "b": "CAST(least(floor(p * 20), 19) AS BIGINT)"}, _BINS)
_PAV = "SELECT a.*, i.iso FROM $in a JOIN (SELECT b, max(low) AS iso FROM (SELECT x.b, j.b AS j, min(j.m) AS low FROM (SELECT b FROM $in WHERE part = 'val') x JOIN (SELECT l.b, h.b AS k, sum(m.s) / sum(m.n) AS m FROM $in l JOIN $in h ON l.part = 'val' AND h.part = 'val' AND l.b <= h.b JOIN $in m ON m.part = 'val' AND m.b BETWEEN l.b AND h.b GROUP BY l.b, h.b) j ON j.b <= x.b AND j.k >= x.b GROUP BY x.b, j.b) q GROUP BY b) i ON a.b = i.b"
_CAND = ({"r": f"close / {lag('close')} - 1", "v": f"volume / nullif({lag('volume')}, 0) - 1", "fwd": f"lead(close) {LAG} / close - 1"}, "SELECT * FROM $in WHERE r IS NOT NULL AND v IS NOT NULL AND fwd IS NOT NULL", {"mul": "r * v", "sub": "r - v"})
_MELTED = _melt("asset, t, fwd", ("r", "v", "mul", "sub"))
_LEGS = ({"r": f"close / {lag('close')} - 1", "fwd": f"lead(close) {LAG} / close - 1"}, "SELECT * FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL", {"rn": "row_number() OVER (PARTITION BY t ORDER BY r, asset)", "n": f"count(*) {ACROSS}"})
_FILL = "(r.low <= s.price * 0.98e0)"
_SOLD = "(s.units > 0 AND r.high >= s.price * 1.02e0)"

STUDIES = [
    # sources and sinks as relations
    _op("SRC05_epoch_units", ({"v": "t * 3600e0 * CASE t % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END"}, {"unit": "CASE WHEN v >= 1e17 THEN 'ns' WHEN v >= 1e14 THEN 'us' WHEN v >= 1e11 THEN 'ms' ELSE 's' END"}, {"sec": "CAST(v / CASE unit WHEN 'ns' THEN 1e9 WHEN 'us' THEN 1e6 WHEN 'ms' THEN 1e3 ELSE 1e0 END AS BIGINT)"}), "asset", "t", "unit", "sec", mapping="A2"),
    _op("SRC06_period_inference", ({"d": f"t - {lag('t')}"}, "SELECT asset, count(*) AS n, CASE WHEN count(*) < 3 THEN 1e0 ELSE least(greatest(PCTL(CASE WHEN d > 0 THEN d END, 0.5), 5 / 60e0), 24e0) END AS hours FROM $in GROUP BY asset"), "asset", "n", "~hours", mapping="A2"),
    _op("SRC03_keep_last", ("SELECT asset, t, close, 0 AS seq FROM $in UNION ALL SELECT asset, t, close + 1, 1 FROM $in WHERE t % 2 = 0", {"k": "row_number() OVER (PARTITION BY asset, t ORDER BY seq DESC)"}, "SELECT * FROM $in WHERE k = 1"), "asset", "t", "~close"),
    _op("SRC09_bars_timeframe", (f"SELECT q.*, 24 AS width FROM ({_RESAMPLE.format(b='CAST(floor(t / 24e0) AS BIGINT) * 24')}) q UNION ALL SELECT q.*, 4 AS width FROM ({_RESAMPLE.format(b='CAST(floor(t / 4e0) AS BIGINT) * 4')}) q",), "asset", "t", "width", "~open", "~high", "~low", "~close", "~volume", mapping="A2"),
    _op("SRC10_wide_panel", ({"p": "nullif(close, 0)"}, {"filled": f"coalesce(p, {lag('p')}, {lag('p', 2)})", "turn": lag("volume")}, {"lp": "ln(filled)", "tradable": "CASE WHEN turn >= 100 THEN 1 ELSE 0 END", "rk": "rank() OVER (PARTITION BY t ORDER BY coalesce(turn, -1) DESC, asset)"}, {"top": "CASE WHEN rk <= 50 THEN 1 ELSE 0 END"}), "asset", "t", "~lp", "tradable", "top"),
    _op("SRC24_manifest", ("SELECT asset, min(t) AS first_t, max(t) AS last_t, count(*) AS n, SHA(SETTEXT(CAST(t AS STRING))) AS digest FROM $in GROUP BY asset",), "asset", "first_t", "last_t", "n", "digest"),
    _op("SNK07_locked_export", (_BOUNDS, "SELECT a.* FROM $in a WHERE a.t <= a.val_end AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT asset AS name FROM $in WHERE substr(SHA(asset), 1, 1) < '6') w WHERE w.name = a.asset)"), "asset", "t", "~close"),
    # filters, windows, joins
    _op("FIL13_stale_options", ({"d": f"t - {lag('t')}"}, "SELECT asset, greatest(CAST(ceil(6 / PCTL(d, 0.5)) AS BIGINT), 2) AS bars FROM $in WHERE d IS NOT NULL GROUP BY asset"), "asset", "bars", mapping="A2"),
    _op("FIL25_panel_subset", (_scalar("max(t) AS end_t"), "SELECT s.* FROM $in s JOIN (SELECT asset FROM (SELECT asset, row_number() OVER (ORDER BY md5(concat('7:', asset)), asset) AS k FROM (SELECT DISTINCT asset FROM $in) d) q WHERE k <= 20) c ON s.asset = c.asset WHERE s.t > s.end_t - 10"), "asset", "t", "~close"),
    _op("REC14_indicator_sweep", ({f"sma_{n}": full("avg", "close", n) for n in (10, 20)} | {f"hi_{n}": full("max", "high", n) for n in (10, 20)} | {f"lo_{n}": full("min", "low", n) for n in (10, 20)}, {f"willr_{n}": f"-100 * (hi_{n} - close) / nullif(hi_{n} - lo_{n}, 0)" for n in (10, 20)}, _melt("asset, t", ("sma_10", "sma_20", "willr_10", "willr_20")), "SELECT * FROM $in WHERE x IS NOT NULL"), "asset", "t", "name", "~x", mapping="B2"),
    _op("JOIN07_position_alignment", ("SELECT s.asset, s.t, s.close, h.before, h.before2 FROM $in s JOIN (SELECT asset, b, lag(c, 1) OVER (PARTITION BY asset ORDER BY b) AS before, lag(c, 2) OVER (PARTITION BY asset ORDER BY b) AS before2 FROM (SELECT asset, CAST(floor(t / 4e0) AS BIGINT) AS b, max_by(close, t) AS c FROM $in GROUP BY 1, 2) g) h ON s.asset = h.asset AND CAST(floor(s.t / 4e0) AS BIGINT) = h.b",), "asset", "t", "~before", "~before2", mapping="A2"),
    # samples and splits
    _op("SMP20_decode_window", ({f"p{k}": f"close / {lag('close', k)} - 1" for k in (1, 2, 3)}, "SELECT * FROM $in WHERE p3 IS NOT NULL", {f"back{k}": f"close / (1 + p{k})" for k in (1, 2, 3)}), "asset", "t", "~back1", "~back2", "~back3"),
    _op("SMP21_entry_range", ({"h": f"lead(high) {LAG} / close - 1", "l": f"1 - lead(low) {LAG} / close", "c": f"lead(close) {LAG} / close - 1"}, "SELECT * FROM $in WHERE c IS NOT NULL", {"up": "close * (1 + h)", "dn": "close * (1 - l)", "mid": "close * (1 + sign(c) * abs(c))"}), "asset", "t", "~up", "~dn", "~mid"),
    _op("SMP23_extractors", ({"last_": "close", "diff": f"close - {lag('close')}", "first4": lag("close", 3), "mean4": full("avg", "close", 4)}, "SELECT * FROM $in WHERE mean4 IS NOT NULL"), "asset", "t", "~last_", "~diff", "~first4", "~mean4"),
    _op("SMP24_target_scale", ({"ret": f"lead(close) {LAG} / close - 1"}, {"y": "100 * ret"}, "SELECT * FROM $in WHERE abs(ret) > 0.000001", {"ratio": "y / ret"}, _scalar("PCTL(ratio, 0.5) AS scale"), "SELECT max(scale) AS scale, avg(CASE WHEN abs(ratio / scale - 1) < 0.01 THEN 1e0 ELSE 0e0 END) AS agree FROM $in"), "~scale", "~agree"),
    _op("SMP25_memory_estimate", ("SELECT asset, count(*) AS n, count(CASE WHEN t % 2 = 0 THEN 1 END) AS ends FROM $in GROUP BY asset", {"samples": "greatest(ends - 4, 0)"}, {"bytes_": "samples * 8 * 6 * 8"}), "asset", "n", "samples", "bytes_"),
    _op("SPL08_single_cutoff", ("SELECT t, count(*) AS n FROM $in GROUP BY t", {"cum": "sum(n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "total": "sum(n) OVER ()"}, {"cut": "min(CASE WHEN cum >= total * 0.7e0 THEN t END) OVER ()"}, "SELECT CASE WHEN t <= cut THEN 'train' WHEN t <= cut + 2 THEN 'embargo' ELSE 'test' END AS part, CAST(sum(n) AS BIGINT) AS n, min(t) AS from_t, max(t) AS to_t FROM $in GROUP BY 1"), "part", "n", "from_t", "to_t"),
    _op("UDF08_rolling_schedule", (f"SELECT first_t, last_t, SERIES(0, greatest(CAST(floor((last_t - first_t - 9) / 5e0) AS INT), 0)) AS k FROM ({_SPAN}) g", "SELECT first_t + k * 5 AS start_t, first_t + k * 5 + 9 AS end_t FROM $in WHERE first_t + k * 5 + 9 <= last_t"), "start_t", "end_t"),
    # evaluation
    _op("MET16_windows_evaluation", (*_SIGNAL, "SELECT s.*, CAST(floor(s.t / 5e0) AS BIGINT) - k.k AS w FROM $in s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) k", spearman("score", "actual", "w"), {"good": "CASE WHEN ic > 0 THEN 1 ELSE 0 END"}), "w", "n", "~ic", "good"),
    _op("MET18_isotonic", (*_BINNED, _PAV, "SELECT * FROM $in WHERE part = 'val'"), "b", "n", "~p", "~iso"),
    _op("MET19_calibration_report", (*_BINNED, _PAV, "SELECT part, CAST(sum(n) AS BIGINT) AS n, sum(n * abs(p - s / n)) / sum(n) AS ece_before, sum(n * abs(iso - s / n)) / sum(n) AS ece_after, sum(n * brier) / sum(n) AS brier_before, sum(s * (1 - iso) * (1 - iso) + (n - s) * iso * iso) / sum(n) AS brier_after FROM $in GROUP BY part"), "part", "n", "~ece_before", "~ece_after", "~brier_before", "~brier_after"),
    _op("MET24_selective_report", (*_SIGNAL, *_SPLITS, {"lvl": "CAST(least(floor(abs(score) * 5), 5) AS BIGINT)", "hit": "CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END"}, "SELECT part, lvl, count(*) AS n, sum(hit) AS hits FROM $in WHERE part IN ('val', 'test') GROUP BY part, lvl", "SELECT a.part, a.lvl, sum(b.n) AS n, sum(b.hits) AS hits FROM $in a JOIN $in b ON a.part = b.part AND b.lvl >= a.lvl GROUP BY a.part, a.lvl", {"acc": "hits / n"}, {"pick": "max_by(CASE WHEN part = 'val' THEN lvl END, CASE WHEN part = 'val' THEN floor(acc * 1000000) * 10 + lvl END) OVER ()"}, "SELECT lvl, CAST(n AS BIGINT) AS n, acc, (acc + 1.9208 / n - 1.96 * sqrt(acc * (1 - acc) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS lo, (acc + 1.9208 / n + 1.96 * sqrt(acc * (1 - acc) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS hi FROM $in WHERE part = 'test' AND lvl = pick"), "lvl", "n", "~acc", "~lo", "~hi"),
    _op("MET26_candle_baseline", ({"cpos": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "upper": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "lower": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)", "rng": "(high - low) / close", "f": f"lead(close) {LAG}"}, "SELECT *, CASE WHEN f > close THEN 1 ELSE 0 END AS y FROM $in WHERE f IS NOT NULL", _melt("y", ("cpos", "upper", "lower", "rng")), {"rk": tie_rank("x", "name")}, f"SELECT name, count(*) AS n, {_auc()} AS auc FROM $in GROUP BY name"), "name", "n", "~auc"),
    _op("MET32_verification", (*_SIGNAL, *_SPLITS, "SELECT 'finite' AS rule, CASE WHEN count(*) = count(CASE WHEN abs(score) < 1e300 AND abs(actual) < 1e300 THEN 1 END) THEN 'pass' ELSE 'fail' END AS verdict FROM $in UNION ALL SELECT 'split order', CASE WHEN max(CASE WHEN part = 'train' THEN t END) < min(CASE WHEN part = 'val' THEN t END) AND max(CASE WHEN part = 'val' THEN t END) < min(CASE WHEN part = 'test' THEN t END) THEN 'pass' ELSE 'fail' END FROM $in UNION ALL SELECT 'both classes', CASE WHEN min(sign(actual)) < max(sign(actual)) THEN 'pass' ELSE 'fail' END FROM $in"), "rule", "verdict"),
    _op("MET36_quantile_regression", (*_RANGE, f"SELECT s.lx, s.ly, k.k / 10e0 AS b FROM $in s CROSS JOIN ({' UNION ALL '.join(f'SELECT {k} AS k' for k in range(-10, 31))}) k", {"e": "ly - b * lx"}, "SELECT s.b, q.a, count(*) AS n, avg(CASE WHEN s.e >= q.a THEN 0.9 * (s.e - q.a) ELSE 0.1 * (q.a - s.e) END) AS loss FROM $in s JOIN (SELECT b, PCTL(e, 0.9) AS a FROM $in GROUP BY b) q ON s.b = q.b GROUP BY s.b, q.a", {"k": "row_number() OVER (ORDER BY floor(loss * 1000000000), b)"}, "SELECT * FROM $in WHERE k = 1"), "n", "~a", "~b", "~loss", mapping="B3"),
    _op("MET41_monthly_refit", (*_RANGE, {"ratio": "y / x"}, "SELECT a.t, a.n, f.q, a.covered FROM (SELECT s.t, count(*) AS n, avg(CASE WHEN s.ratio <= f.q THEN 1e0 ELSE 0e0 END) AS covered FROM $in s JOIN (SELECT m, PCTL(ratio, 0.8) AS q FROM (SELECT s.t + k.k AS m, s.ratio FROM $in s CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4) k) e GROUP BY m) f ON s.t = f.m GROUP BY s.t) a JOIN (SELECT m, PCTL(ratio, 0.8) AS q FROM (SELECT s.t + k.k AS m, s.ratio FROM $in s CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4) k) e GROUP BY m) f ON a.t = f.m"), "t", "n", "~q", "~covered", mapping="B3"),
    _op("MET42_forward_chain", (*_RANGE, {"yr": "CAST(floor(t / 12e0) AS BIGINT) + 1970"}, "SELECT yr, count(*) AS n, sum(lx) AS sx, sum(ly) AS sy, sum(lx * lx) AS sxx, sum(lx * ly) AS sxy FROM $in GROUP BY yr", {c: f"sum({a}) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c, a in {"pn": "n", "px": "sx", "py": "sy", "pxx": "sxx", "pxy": "sxy"}.items()}, "SELECT * FROM $in WHERE pn >= 10", {"slope": "(pn * pxy - px * py) / (pn * pxx - px * px)"}, {"bias": "(sy - slope * sx) / n - (py - slope * px) / pn"}), "yr", "n", "~slope", "~bias", mapping="B3"),
    # simulation
    _op("SIM07_extra_families", ({"top20": full("max", "high", 20, prior(20)), "top55": full("max", "high", 55, prior(55)), "mid": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20), "atr": full("avg", "high - low", 20), "slow": full("avg", "close", 50), "mv": full("avg", "volume", 20, prior(20)), "d": f"close - {lag('close')}"}, {"up2": full("sum", "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", 2), "dn2": full("sum", "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END", 2)}, {"rsi2": "100 * up2 / nullif(up2 + dn2, 0)", "tight": "CASE WHEN 2 * sd < 1.5 * atr THEN 1 ELSE 0 END"}, {"donchian20": "CASE WHEN close > top20 THEN 1 ELSE 0 END", "donchian55": "CASE WHEN close > top55 THEN 1 ELSE 0 END", "rsi2_pullback": "CASE WHEN rsi2 < 10 AND close > slow THEN 1 ELSE 0 END", "keltner_squeeze": f"CASE WHEN tight = 0 AND {lag('tight')} = 1 AND close > mid THEN 1 ELSE 0 END", "volume_donchian": "CASE WHEN close > top20 AND volume > 1.5 * mv THEN 1 ELSE 0 END"}), "asset", "t", "donchian20", "donchian55", "rsi2_pullback", "keltner_squeeze", "volume_donchian", mapping="B2"),
    _op("SIM09_hedged_legs", (*_LEGS, "SELECT t, avg(CASE WHEN rn = n THEN fwd END) AS lead_, avg(fwd) AS hedge, count(*) AS n FROM $in GROUP BY t HAVING count(*) >= 5", {"net": "greatest(lead_, -0.5) - hedge - 0.0028", "cum": "sum(greatest(lead_, -0.5) - hedge - 0.0028) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}), "t", "n", "~net", "~cum", mapping="B3"),
    _op("SIM10_range_fade", ({"bid": full("min", "low", 12, prior(12)), "top": full("max", "high", 12, prior(12)), "nh": f"lead(high) {LAG}", "nc": f"lead(close) {LAG}"}, "SELECT * FROM $in WHERE bid IS NOT NULL AND nc IS NOT NULL AND low <= bid", {"entry": "least(open, bid)", "goal": "(bid + top) / 2"}, {"ret": "CASE WHEN nh >= goal THEN goal ELSE nc END / entry - 1"}), "asset", "t", "~entry", "~ret", mapping="B2"),
    _op("SIM11_first_touch", ({"d": "CAST(floor(t / 24e0) AS BIGINT)"}, "SELECT e.asset, e.d, e.c, min(CASE WHEN s.high >= e.c * 1.5e0 THEN s.t END) AS up_t, min(CASE WHEN s.low <= e.c * 0.5e0 THEN s.t END) AS dn_t FROM (SELECT asset, d, max_by(close, t) AS c FROM $in GROUP BY asset, d) e JOIN $in s ON s.asset = e.asset AND s.d = e.d + 1 GROUP BY e.asset, e.d, e.c", {"first": "CASE WHEN up_t IS NULL AND dn_t IS NULL THEN 'none' WHEN dn_t IS NULL OR up_t < dn_t THEN 'up' WHEN up_t IS NULL OR dn_t < up_t THEN 'down' ELSE 'same bar' END"}), "asset", "d", "first", mapping="A2"),
    Scan("SIM12_grid_path", (), ("high", "low", "close"), {"price": ("NULL", f"CASE WHEN s.price IS NULL THEN r.close WHEN {_FILL} AND s.units < 5 THEN s.price * 0.98e0 WHEN {_SOLD} THEN s.price * 1.02e0 ELSE s.price END"), "units": ("0", f"CASE WHEN s.price IS NULL THEN 0 WHEN {_FILL} AND s.units < 5 THEN s.units + 1 WHEN {_SOLD} THEN s.units - 1 ELSE s.units END"), "cash": ("0", f"CASE WHEN s.price IS NULL THEN 0 WHEN {_FILL} AND s.units < 5 THEN s.cash - s.price * 0.98e0 WHEN {_SOLD} THEN s.cash + s.price * 1.02e0 ELSE s.cash END")}, ("price", "units", "cash")),
    _op("SIM18_asset_report", (*_SIGNAL, {"u": "abs(score)"}, {"bucket": "CASE WHEN u < 0.2 THEN 'low' WHEN u < 1 THEN 'medium' ELSE 'high' END"}, "SELECT asset, bucket, count(*) AS n, avg(CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END) AS win, avg(abs(score - actual)) AS err FROM $in GROUP BY asset, bucket"), "asset", "bucket", "n", "~win", "~err"),
    _op("SIM22_up_share", (*_SIGNAL, {"rn": "row_number() OVER (PARTITION BY t ORDER BY score, asset)", "n": f"count(*) {ACROSS}"}, {"dec": "CAST(floor((rn - 1) * 10e0 / n) AS BIGINT)"}, "SELECT dec, count(*) AS n, count(CASE WHEN actual > 0.1 THEN 1 END) / nullif(CAST(count(CASE WHEN abs(actual) > 0.1 THEN 1 END) AS DOUBLE), 0) AS up_share FROM $in GROUP BY dec"), "dec", "n", "~up_share"),
    # discovery
    _op("ML01_candidates", (*_CAND, _MELTED, spearman("x", "fwd", "name")), "name", "n", "~ic"),
    _op("ML02_predictors", ({"d": f"close - {lag('close')}", "r": f"close / {lag('close')} - 1", "mid": full("avg", "close", 21)}, {"up": full("sum", "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", 14), "dn": full("sum", "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END", 14), "sd": full("stddev_samp", "r", 14), "mom": full("sum", "r", 14)}, {"cmo": "100 * (up - dn) / nullif(up + dn, 0)", "dpo": f"{lag('close', 11)} - mid", "asym": "CASE WHEN mom > 0 THEN mom ELSE 1.5 * mom END", "adjusted": "mom / nullif(sd, 0)"}), "asset", "t", "~cmo", "~dpo", "~asym", "~adjusted", mapping="B2"),
    Scan("ML02_true_strength", ({"d": f"coalesce(close - {lag('close')}, 0)"},), ("d",), {"a": ("NULL", ema("r.d", "a", 25)), "b": ("NULL", ema("abs(r.d)", "b", 25)), "aa": ("NULL", ema(f"({ema('r.d', 'a', 25)})", "aa", 13)), "bb": ("NULL", ema(f"({ema('abs(r.d)', 'b', 25)})", "bb", 13))}, ("aa", "bb")),
    _op("ML03_target_reference", ({"up": f"lead(high) {LAG} / close - 1", "dn": f"lead(low) {LAG} / close - 1"}, "SELECT * FROM $in WHERE up IS NOT NULL"), "asset", "t", "~up", "~dn"),
    _op("ML04_batch_classify", (*_CAND, _MELTED, {"w": "CAST(floor(t / 4e0) AS BIGINT)"}, spearman("x", "fwd", "name, w", least=10), {"z": "ic * sqrt(n - 1e0)"}, "SELECT name, count(ic) AS n_ok, avg(ic) AS mean_ic, CASE WHEN min(sign(ic)) = max(sign(ic)) THEN 1 ELSE 0 END AS consistent, avg(CASE WHEN abs(z) > 1.96 THEN 1e0 ELSE 0e0 END) AS significant FROM $in GROUP BY name", {"verdict": "CASE WHEN n_ok < 5 THEN 'pending' WHEN consistent = 1 AND significant >= 0.34 THEN 'accepted' ELSE 'rejected' END"}), "name", "n_ok", "~mean_ic", "verdict", mapping="B3"),
    _op("ML11_tokens", ({"c": f"CASE WHEN close > {lag('close')} THEN 'u' WHEN close < {lag('close')} THEN 'd' ELSE 'f' END"}, {"word": f"{lag('c', 2)} || {lag('c')}"}, "SELECT word, c, count(*) AS n FROM $in WHERE word IS NOT NULL GROUP BY word, c", {"total": "sum(n) OVER (PARTITION BY word)"}, "SELECT word, CAST(max(total) AS BIGINT) AS n, -sum(n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE))) AS entropy FROM $in GROUP BY word"), "word", "n", "~entropy"),
    _op("ML11_haar", ({"rn": f"row_number() {LAG}", "b": f"lead(close) {LAG}"}, "SELECT * FROM $in WHERE rn % 2 = 1 AND b IS NOT NULL", "SELECT asset, count(*) AS n, sum((close + b) * (close + b)) / 2 AS smooth, sum((close - b) * (close - b)) / 2 AS detail FROM $in GROUP BY asset"), "asset", "n", "~smooth", "~detail"),
    _op("MDL05_ensemble", (f"SELECT asset, t, 'a' AS member, close AS mu, (high - low) / 4 AS sd FROM $in UNION ALL SELECT asset, t, 'b', open, (high - low) / 3 FROM $in", "SELECT asset, t, avg(mu) AS m, avg(sd * sd) AS noise, avg(mu * mu) - avg(mu) * avg(mu) AS spread FROM $in GROUP BY asset, t", {"total": "noise + greatest(spread, 0)"}), "asset", "t", "~m", "~noise", "~total"),
    # scalars
    _op("SCL08_arrays", ({"r": f"coalesce(close / {lag('close')}, 1)"}, {"prod": f"exp(sum(ln(r)) OVER (PARTITION BY asset ORDER BY t))", "peak": "max(close) OVER (PARTITION BY asset ORDER BY t)", "pos": "row_number() OVER (PARTITION BY asset ORDER BY close, t) - 1"}), "asset", "t", "~prod", "~peak", "pos", mapping="B3"),
    _op("SCL10_timeframes", ("SELECT * FROM (" + _union("'1d';' 4H';'15min';'1D ';'60m'", "raw") + ") v", {"low_": "lower(trim(raw))"}, {"tf": "CASE WHEN low_ LIKE '%d' THEN upper(low_) ELSE regexp_replace(low_, 'm$', 'min') END"}), "raw", "tf"),
    # study scripts
    _op("STD03_direction_scores", ({"asym": f"avg(high - open) {last(5)} - avg(open - low) {last(5)}", "pc": f"close / {lag('close')} - 1", "cpos": "coalesce((close - low) / nullif(high - low, 0), 0.5)"}, {"nasym": f"asym / nullif(avg(high - low) {last(5)}, 0)", "agree": "CASE WHEN sign(pc) = sign(asym) THEN pc ELSE 0e0 END", "prod": "pc * (cpos - 0.5)"}), "asset", "t", "~asym", "~nasym", "~agree", "~prod"),
    _op("STD07_hit_stats", (*_PROB, {"m": "CAST(floor(t / 30e0) AS BIGINT)", "up": "CASE WHEN score > 0 THEN 1 ELSE 0 END"}, "SELECT m, count(*) AS n, avg(CASE WHEN up = y THEN 1e0 ELSE 0e0 END) AS acc, (avg(CASE WHEN y = 1 THEN CAST(up AS DOUBLE) END) + avg(CASE WHEN y = 0 THEN 1e0 - up END)) / 2 AS balanced FROM $in GROUP BY m"), "m", "n", "~acc", "~balanced"),
    _op("STD08_entry_simulation", (*_BRACKET, {"limit_": "close * CASE WHEN dir > 0 THEN 0.95e0 ELSE 1.05e0 END", "filled": "CASE WHEN dir <> 0 AND adv >= 0.05 THEN 1 ELSE 0 END"}, {"taker": "dir * end_ - 0.001", "maker": "CASE WHEN filled = 1 THEN dir * (close * (1 + end_) / limit_ - 1) - 0.0004 END"}, "SELECT dir, count(*) AS n, CAST(sum(filled) AS BIGINT) AS fills, avg(taker) AS taker, avg(maker) AS maker FROM $in GROUP BY dir"), "dir", "n", "fills", "~taker", "~maker"),
    _op("STD09_magnitude_regression", ({"v": full("avg", "(high - low) / close", 3), "y": f"abs(lead(close) {LAG} / close - 1)"}, _BOUNDS, "SELECT *, ln(v) AS lv, ln(y) AS ly, CASE WHEN t <= train_end THEN 'val' ELSE 'test' END AS part FROM $in WHERE v > 0 AND y > 0", _scalar("covar_pop(lv, ly) / nullif(var_pop(lv), 0) AS slope, avg(ly) - covar_pop(lv, ly) / nullif(var_pop(lv), 0) * avg(lv) AS base", "part = 'val'"), "SELECT part, count(*) AS n, max(slope) AS slope, max(base) AS base, avg(abs(ly - base - slope * lv)) AS err FROM $in GROUP BY part"), "part", "n", "~slope", "~base", "~err"),
    _op("STD10_collapse_report", (*_PROB, "SELECT asset, count(*) AS n, avg(CASE WHEN p > 0.5 THEN 1e0 ELSE 0e0 END) AS up_share, stddev_pop(p) AS spread FROM $in GROUP BY asset", {"collapsed": "CASE WHEN up_share < 0.02 OR up_share > 0.98 OR spread < 0.001 THEN 1 ELSE 0 END"}), "asset", "n", "~up_share", "~spread", "collapsed"),
    _op("STD11_rank_portfolio", (*_SIGNAL, {"rk": f"{tie_rank('score')} / count(*) {ACROSS}"}, "SELECT t, count(*) AS n, sum((rk - 0.5) * actual) / nullif(sum(abs(rk - 0.5)), 0) AS ret FROM $in GROUP BY t HAVING count(*) >= 5"), "t", "n", "~ret"),
    _op("STD12_side_bracket", (*_BRACKET, {"s": "close / open - 1"}, {"rn": "row_number() OVER (PARTITION BY t ORDER BY s, asset)", "n": f"count(*) {ACROSS}"}, {"side": "CASE WHEN rn > 0.8e0 * n THEN 1 WHEN rn <= 0.2e0 * n THEN -1 ELSE 0 END"}, "SELECT side, count(*) AS n, avg(CASE WHEN CASE WHEN side > 0 THEN dn ELSE up END >= 0.1 THEN -0.1 ELSE side * end_ END) AS stopped, avg(side * end_) AS held FROM $in WHERE side <> 0 GROUP BY side"), "side", "n", "~stopped", "~held"),
    _op("STD13_auc_in_quintiles", ({"v": "(high - low) / close", "f": f"lead(close) {LAG}", "s": "close / open - 1"}, "SELECT *, CASE WHEN f > close THEN 1 ELSE 0 END AS y FROM $in WHERE f IS NOT NULL", {"b": "CASE WHEN v = 0 THEN 0 WHEN v < 0.5 THEN 1 WHEN v < 1 THEN 2 ELSE 3 END"}, {"rk": tie_rank("s", "b")}, f"SELECT b, count(*) AS n, {_auc()} AS auc FROM $in GROUP BY b"), "b", "n", "~auc"),
    # replica 0 is the score, the others are random orders of each step
    _op(
        "STD14_daily_selection",
        (
            *_SIGNAL, "SELECT *, SERIES(0, 200) AS k FROM $in", {"u": "CASE WHEN k = 0 THEN score ELSE UNIT(concat_ws(':', CAST(t AS STRING), asset, CAST(k AS STRING))) END"},
            {"rn": "row_number() OVER (PARTITION BY k, t ORDER BY u DESC, asset)", "n": "count(*) OVER (PARTITION BY k, t)"},
            "SELECT k, count(*) AS n, avg(actual) AS mean FROM $in WHERE rn <= 0.2e0 * n GROUP BY k",
            {"observed": "max(CASE WHEN k = 0 THEN mean END) OVER ()"},
            "SELECT max(n) AS n, max(observed) AS observed, count(*) - 1 AS replicas, (1 + count(CASE WHEN k > 0 AND abs(mean) >= abs(observed) THEN 1 END)) / CAST(count(*) AS DOUBLE) AS p_value FROM $in",
        ),
        "n", "~observed", "replicas", "~p_value",
    ),
    _op("STD15_benchmark_features", ({f"r{n}": f"close / {lag('close', n)} - 1" for n in (1, 3)} | {"vz": f"volume / nullif(avg(volume) {last(4)}, 0) - 1"}, "SELECT * FROM $in WHERE r3 IS NOT NULL", {"k1": f"{tie_rank('r1')} / count(*) {ACROSS}", "k3": f"{tie_rank('r3')} / count(*) {ACROSS}", "part": "CASE WHEN t % 10 < 6 THEN 'train' WHEN t % 10 < 8 THEN 'purged' ELSE 'test' END"}), "asset", "t", "part", "~r1", "~r3", "~vz", "~k1", "~k3"),
    _op("STD16_trend_combos", ({"r": f"lead(close) {LAG} / close - 1", "s1": full("avg", "close", 5), "s2": full("avg", "close", 20), "s3": full("avg", "close", 50)}, "SELECT * FROM $in WHERE s3 IS NOT NULL AND r IS NOT NULL", {"w": "(CASE WHEN close > s1 THEN 1e0 ELSE 0e0 END + CASE WHEN close > s2 THEN 1e0 ELSE 0e0 END + CASE WHEN close > s3 THEN 1e0 ELSE 0e0 END) / 3"}, "SELECT asset, count(*) AS n, avg(w) AS exposure, avg(w * r) AS mean, avg(w * r) / nullif(stddev_pop(w * r), 0) AS sharpe FROM $in GROUP BY asset"), "asset", "n", "~exposure", "~mean", "~sharpe", mapping="B2"),
    _op("STD17_volatility_sizing", ({"p": f"close / {lag('close')} - 1", "f": f"lead(close) {LAG} / close - 1"}, {"s": full("stddev_samp", "p", 12)}, "SELECT *, sign(p) * least(0.3 / s, 2) AS w FROM $in WHERE s > 0 AND f IS NOT NULL", "SELECT asset, count(*) AS n, avg(w * f) AS mean, stddev_pop(w * f) AS sd FROM $in GROUP BY asset"), "asset", "n", "~mean", "~sd", mapping="B2"),
]
