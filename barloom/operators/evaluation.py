"""Further targets, decoders, metrics, resampling inference and trade scans over bars.

Statistics of the whole frame are single rows, so joining them back is a broadcast of
one row; boundaries over time are found on counts a step, not on sorted rows.
"""

from __future__ import annotations

from statistics import NormalDist

from .core import EVER, LAG, Operator, full, lag, last, prior
from .cross_section import spearman, tie_rank
from .recursions import Scan
from .relational import _BOUNDS, _BRACKET, _FLAT, _PROB, _RUN, _SIGNAL, _SPAN, _SPLITS, _op


def _scalar(expressions: str, where: str = "") -> str:
    """Every row with statistics of the whole frame beside it."""
    return f"SELECT s.*, g.* FROM $in s CROSS JOIN (SELECT {expressions} FROM $in{' WHERE ' + where if where else ''}) g"


def _edges(x: str, n: int, where: str = "") -> tuple[str, dict[str, str]]:
    """Quantile edges and the bucket of x: how many edges lie at or below it."""
    cuts = ", ".join(f"PCTL({x}, {k / n!r}) AS e{k}" for k in range(1, n))
    return _scalar(cuts, where), {"bucket": " + ".join(f"CASE WHEN {x} >= e{k} THEN 1 ELSE 0 END" for k in range(1, n))}


_NEXT = ({"f": f"lead(close) {LAG}"}, "SELECT * FROM $in WHERE f IS NOT NULL", {"ret": "(f - close) / close"})
_QUART = {"n8": f"count(*) {last(8)}", "q1": f"PCTL(close, 0.25) {last(8)}", "q2": f"PCTL(close, 0.5) {last(8)}", "q3": f"PCTL(close, 0.75) {last(8)}"}
_FULL8 = "SELECT * FROM $in WHERE n8 = 8"
_STEPS = "SELECT t, count(*) AS n FROM $in GROUP BY t"
_CUM = {"cum": "sum(n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "total": "sum(n) OVER ()"}
_DIFF = ({"other": "avg(actual) OVER (PARTITION BY t)"}, "SELECT t, avg(abs(actual - score) - abs(actual - other)) AS x FROM $in GROUP BY t")
_NW = ({"d": "x - avg(x) OVER ()", "m": "avg(x) OVER ()"}, {"d1": "lag(d, 1) OVER (ORDER BY t)", "d2": "lag(d, 2) OVER (ORDER BY t)"})
#: Expected maximum of the Sharpe ratios of 10 unskilled trials, in standard deviations.
_TRIALS = 0.4227843350984671 * NormalDist().inv_cdf(1 - 1 / 10) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (10 * 2.718281828459045))
_ZWIN = ({f"x{k}": lag("close", k) if k else "close" for k in range(4)} | {"rn": f"row_number() {LAG}", "total": "count(*) OVER (PARTITION BY asset)"}, "SELECT * FROM $in WHERE rn >= 4", {"m": "(x0 + x1 + x2 + x3) / 4"}, {"sd": "sqrt(((x0 - m) * (x0 - m) + (x1 - m) * (x1 - m) + (x2 - m) * (x2 - m) + (x3 - m) * (x3 - m)) / 4)"}, "SELECT * FROM $in WHERE sd > 0", {f"z{k}": f"(x{k} - m) / sd" for k in range(4)})

# one position an asset: entry at the open after a signal, the stop before the target, fills at a gapped open
_IN = "(s.pos = 1 OR r.sig = 1)"
_AT = "CASE WHEN s.pos = 1 THEN s.entry ELSE r.open END"
_RISK = "CASE WHEN s.pos = 1 THEN s.risk ELSE r.atr END"
_AGE = "CASE WHEN s.pos = 1 THEN s.age + 1 ELSE 1 END"
_STOP, _GOAL = f"({_AT} - 1.5e0 * ({_RISK}))", f"({_AT} + 3e0 * ({_RISK}))"
_EXIT = f"CASE WHEN NOT {_IN} THEN NULL WHEN r.low <= {_STOP} THEN least(r.open, {_STOP}) WHEN r.high >= {_GOAL} THEN greatest(r.open, {_GOAL}) WHEN {_AGE} >= 5 OR r.final = 1 THEN r.close END"

EVALUATION = [
    _op("FIL16_flat_idle_runs", (_FLAT, _RUN, {"run": f"sum(change) {EVER}"}, {"len": "count(*) OVER (PARTITION BY asset, run)"}, "SELECT * FROM $in WHERE flat = 1 AND len >= 3 AND trades <= 1"), "asset", "t", "len"),
    _op("FIL21_sealed_symbols", ("SELECT a.* FROM $in a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_replace(upper(trim(name)), 'USDT$', '') AS name FROM (SELECT ' ' || asset || 'usdt' AS name FROM $in WHERE substr(SHA(asset), 1, 1) IN ('0', '1', '2', '3')) n) w WHERE w.name = a.asset)",), "asset", "t"),
    _op("FIL27_name_matching", ("SELECT coalesce(c.name, d.asset) AS name, CASE WHEN d.asset IS NULL THEN 'config only' WHEN c.name IS NULL THEN 'data only' WHEN c.raw = d.asset THEN 'exact' ELSE 'normalised' END AS state FROM (SELECT raw, regexp_replace(upper(raw), 'USDT$', '') AS name FROM (SELECT '7usdt' AS raw UNION ALL SELECT '11' UNION ALL SELECT 'none') r) c FULL OUTER JOIN (SELECT DISTINCT asset FROM $in) d ON c.name = d.asset",), "name", "state"),
    _op("RES04_all_members_range", ({"b": "CAST(floor(t / 4e0) AS BIGINT) * 4"}, "SELECT asset, b AS t, count(*) AS members, max(high) AS hi, min(low) AS lo, max_by(close, t) AS close FROM $in GROUP BY asset, b HAVING count(*) = 4", {"range_pct": "100 * (hi - lo) / close"}), "asset", "t", "~range_pct", mapping="A2"),
    _op("RES11_calendar_parts", ({"h": "t % 24", "dow": "(CAST(floor(t / 24e0) AS BIGINT) + 3) % 7"}, {"hs": "sin(2 * pi() * h / 24)", "hc": "cos(2 * pi() * h / 24)", "ds": "sin(2 * pi() * dow / 7)", "dc": "cos(2 * pi() * dow / 7)"}), "asset", "t", "h", "dow", "~hs", "~hc", "~ds", "~dc", mapping="A2"),
    _op("REC13_library_indicators", ({"typ": "(high + low + close) / 3", "pc": lag("close")}, {"flow": f"typ * volume * sign(typ - {lag('typ')})", "signed": "CASE WHEN pc IS NULL THEN volume ELSE sign(close - pc) * volume END", "mfv": "coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume"}, {"obv": f"sum(signed) {EVER}", "ad": f"sum(mfv) {EVER}", "gain": full("sum", "CASE WHEN flow > 0 THEN flow WHEN flow <= 0 THEN 0e0 END", 14), "drop_": full("sum", "CASE WHEN flow < 0 THEN -flow WHEN flow >= 0 THEN 0e0 END", 14), "cmf": f"{full('sum', 'mfv', 20)} / nullif({full('sum', 'volume', 20)}, 0)"}, {"mfi": "100 * gain / nullif(gain + drop_, 0)", "bop": "(close - open) / nullif(high - low, 0)", "wcp": "(high + low + 2 * close) / 4"}), "asset", "t", "~typ", "~obv", "~ad", "~mfi", "~cmf", "~bop", "~wcp", mapping="B2"),
    _op("JOIN09_left_one_to_one", ("SELECT a.asset, a.t, a.close, b.extra FROM $in a LEFT JOIN (SELECT asset, t, max(volume) AS extra FROM $in WHERE trades > 1 GROUP BY asset, t) b ON a.asset = b.asset AND a.t = b.t", {"copies": "count(*) OVER (PARTITION BY asset, t)"}), "asset", "t", "~extra", "copies"),
    _op("JOIN16_universe_join", ("SELECT a.* FROM $in a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT asset || CASE WHEN t % 2 = 0 THEN 'USDT' ELSE 'usdt' END AS s FROM $in WHERE volume > 300) u WHERE regexp_replace(upper(u.s), 'USDT$', '') = upper(a.asset))",), "asset", "t", "~close"),
    _op("AGG06_sum_min_count", ("SELECT asset, sum(CASE WHEN trades > 2 THEN volume END) AS busy FROM $in GROUP BY asset",), "asset", "~busy"),
    _op("AGG10_feature_availability", ({"a": lag("close"), "b": lag("close", 12), "c": full("avg", "close", 30)}, "SELECT asset, count(a) AS a, count(b) AS b, count(c) AS c FROM $in GROUP BY asset", "SELECT asset, 'lag1' AS feature, CASE WHEN a > 0 THEN 1 ELSE 0 END AS present FROM $in UNION ALL SELECT asset, 'lag12', CASE WHEN b > 0 THEN 1 ELSE 0 END FROM $in UNION ALL SELECT asset, 'mean30', CASE WHEN c > 0 THEN 1 ELSE 0 END FROM $in"), "asset", "feature", "present"),
    _op("AGG21_robustness", ({"status": "CASE WHEN high = low THEN 'flat' WHEN trades = 1 THEN 'thin' ELSE 'ok' END"}, "SELECT asset, count(*) AS n, count(CASE WHEN status = 'ok' THEN 1 END) AS n_ok, count(CASE WHEN status = 'ok' THEN 1 END) / CAST(count(*) AS DOUBLE) AS frac, SETTEXT(status) AS statuses FROM $in GROUP BY asset"), "asset", "n", "n_ok", "~frac", "statuses"),
    _op("AGG25_bucket_success", (*_SIGNAL, {"conf": "abs(score)"}, *_edges("conf", 5), "SELECT bucket, count(*) AS n, avg(CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END) AS success FROM $in GROUP BY bucket"), "bucket", "n", "~success"),
    _op("AGG27_naive_class_baseline", (*_PROB, "SELECT asset, count(*) AS n, greatest(avg(CAST(y AS DOUBLE)), 1 - avg(CAST(y AS DOUBLE))) AS majority FROM $in GROUP BY asset"), "asset", "n", "~majority"),
    _op("AGG29_normalisation_audit", ({"m": full("avg", "close", 10), "s": full("stddev_pop", "close", 10)}, "SELECT *, greatest(least((close - m) / s, 2), -2) AS z FROM $in WHERE s > 0", "SELECT asset, count(*) AS n, avg(z) AS mean, stddev_pop(z) AS sd, min(z) AS lo, max(z) AS hi, avg(CASE WHEN abs(z) >= 2 THEN 1e0 ELSE 0e0 END) AS clipped FROM $in GROUP BY asset"), "asset", "n", "~mean", "~sd", "~lo", "~hi", "~clipped"),
    _op("AGG30_skip_summary", ("SELECT asset, count(*) AS n, max(t) AS end_t FROM $in GROUP BY asset", _scalar("max(end_t) AS last_t"), {"status": "CASE WHEN n < 10 THEN 'too short' WHEN end_t < last_t - 10 THEN 'ended' ELSE 'kept' END"}, "SELECT status, count(*) AS n FROM $in GROUP BY status"), "status", "n"),
    _op("SRT01_stable_order", ({"g": "CAST(floor(t / 5e0) AS BIGINT)"}, {"k": "row_number() OVER (PARTITION BY g ORDER BY t, asset)"}), "g", "k", "asset", "t"),
    _op("SRT05_candidate_ranking", ({"target": full("avg", "close", 14)} | {f"c{n}": full("avg", "close", n) for n in (10, 14, 20)} | {"back": "row_number() OVER (PARTITION BY asset ORDER BY t DESC)"}, "SELECT " + ", ".join(f"max(CASE WHEN back <= 20 THEN abs(c{n} / target - 1) END) AS e{n}" for n in (10, 14, 20)) + " FROM $in", "SELECT 'mean10' AS name, e10 AS err FROM $in UNION ALL SELECT 'mean14', e14 FROM $in UNION ALL SELECT 'mean20', e20 FROM $in", {"k": "row_number() OVER (ORDER BY err, name)"}), "name", "~err", "k", mapping="B2"),
    _op("SMP07_return_target", (*_NEXT, {"y": "100 * greatest(least((f - close) / CASE WHEN abs(close) > 0.00000001 THEN close ELSE 0.00000001 END, 1), -1)"}), "asset", "t", "~y"),
    _op("SMP09_retarget_modes", (*_NEXT, _QUART, _FULL8, {"magnitude": "abs(ret)", "scaled": "(f - close) / greatest(q3 - q1, 0.00000001)", "pos": "coalesce((f - q1) / nullif(q3 - q1, 0), 0.5)"}, _BOUNDS, _scalar("PCTL(magnitude, 0.5) AS typical", "t <= train_end"), {"relative": "magnitude / typical"}), "asset", "t", "~ret", "~magnitude", "~scaled", "~pos", "~relative"),
    _op("SMP10_volnorm_scale", (_QUART, _FULL8, {"s": "(q3 - q1) / abs(close)"}, _scalar("PCTL(s, 0.5) AS typical"), {"scale": "CASE WHEN s > 0.000001 THEN s ELSE typical END"}), "asset", "t", "~scale"),
    _op("SMP14_robust_magnitude", ({"r": f"close / {lag('close')} - 1"}, {"n": f"count(r) {last(8)}", "med": f"PCTL(abs(r), 0.5) {last(8)}", "sd": f"stddev_pop(r) {last(8)}"}, "SELECT * FROM $in WHERE n = 8", {"mag": "CASE WHEN 1.4826 * med > 0.00000001 THEN 1.4826 * med ELSE sd END"}), "asset", "t", "~mag"),
    _op("SMP15_window_standardise", ({**_QUART, "lo": f"min(close) {last(8)}", "hi": f"max(close) {last(8)}"}, _FULL8, {"robust": "(close - q2) / greatest(q3 - q1, 0.00000001)", "minmax": "coalesce((close - lo) / nullif(hi - lo, 0), 0)"}), "asset", "t", "~robust", "~minmax"),
    _op("SMP16_ohlc_channels", ({f"r{c[0]}": f"ln({c} / {lag('close')})" for c in ("open", "high", "low", "close")}, "SELECT * FROM $in WHERE rc IS NOT NULL", _BOUNDS, _scalar(", ".join(f"avg(r{c}) AS m{c}, stddev_pop(r{c}) AS s{c}" for c in "ohlc"), "t <= train_end"), {f"z{c}": f"greatest(least((r{c} - m{c}) / s{c}, 5), -5)" for c in "ohlc"}), "asset", "t", *[f"~z{c}" for c in "ohlc"]),
    _op("SMP19_invert_predictions", (*_NEXT, _QUART, _FULL8, {"w": "(f - close) / greatest(q3 - q1, 0.00000001)", "l": "ln(f / close)"}, {"by_return": "close * (1 + ret) / f", "by_scale": "(close + w * greatest(q3 - q1, 0.00000001)) / f", "by_log": "close * exp(l) / f"}), "asset", "t", "~by_return", "~by_scale", "~by_log"),
    # the pair of boundaries whose kept shares of training and validation, after both gaps, are nearest to what is asked; steps, not rows
    _op(
        "SPL02_boundary_search",
        (
            _STEPS, _CUM, {"i": "row_number() OVER (ORDER BY t)"},
            "SELECT a.t AS t1, b.t AS t2, a.cum AS train, b.cum - g.cum AS val, a.total - h.cum AS test FROM $in a JOIN $in g ON g.i = a.i + 2 JOIN $in b ON b.i > g.i JOIN $in h ON h.i = b.i + 2",
            "SELECT *, train / CAST(train + val + test AS DOUBLE) AS train_share, val / CAST(train + val + test AS DOUBLE) AS val_share FROM $in WHERE train >= 10 AND val >= 10 AND test >= 10",
            {"k": "row_number() OVER (ORDER BY floor((abs(train_share - 0.7) + abs(val_share - 0.15)) * 1000000000), t1, t2)"},
            "SELECT * FROM $in WHERE k = 1",
        ),
        "t1", "t2", "~train_share", "~val_share",
    ),
    _op("SPL11_pooled_quantile", (_STEPS, _CUM, "SELECT min(CASE WHEN cum > floor(total * 0.7e0) THEN t END) AS t1, min(CASE WHEN cum > floor(total * 0.85e0) THEN t END) AS t2 FROM $in"), "t1", "t2"),
    _op("MET02_decode_continuous", (*_SIGNAL, {"change_pct": "100 * score", "real": "exp(least(score, 5)) - 1", "by_class": "sign(actual) * abs(score)"}), "asset", "t", "~change_pct", "~real", "~by_class"),
    _op("MET03_decode_categorical", (*_SIGNAL, {"a": "exp(least(score, 20))", "b": "exp(-least(score, 20))"}, {"up": "a / (a + b + 1)", "down": "b / (a + b + 1)", "flat": "1 / (a + b + 1)"}, {"proba": "greatest(up, down, flat)", "label": "CASE WHEN up >= down AND up >= flat THEN 'up' WHEN down >= flat THEN 'down' ELSE 'flat' END"}), "asset", "t", "label", "~proba"),
    _op("MET09_integrity", (*_SIGNAL, "SELECT asset, count(*) AS n, avg(abs(score - actual)) AS mae, avg(abs(actual)) AS naive, avg(score - actual) AS bias, avg(abs(score - actual)) / nullif(avg(abs(actual)), 0) AS ratio FROM $in GROUP BY asset"), "asset", "n", "~mae", "~naive", "~bias", "~ratio"),
    _op("MET10_decode_roundtrip", (*_NEXT, {"back": "ln(close * (1 + ret) / close)", "direct": "ln(f / close)"}, "SELECT asset, count(*) AS n, CASE WHEN max(abs(back - direct)) < 0.000000001 THEN 1 ELSE 0 END AS exact FROM $in GROUP BY asset"), "asset", "n", "exact"),
    _op("MET21_selective_curve", (*_SIGNAL, {"conf": "abs(score)", "hit": "CASE WHEN score * actual > 0 THEN 1e0 ELSE 0e0 END"}, *_edges("conf", 10), "SELECT bucket, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc FROM $in GROUP BY bucket"), "bucket", "n", "~conf", "~acc"),
    _op("MET23_direction_scores", (*_PROB, {"margin": "2 * p - 1", "nig": "score / (1 + abs(score))"}, {"agree": "CASE WHEN sign(margin) = sign(nig) THEN margin ELSE 0e0 END"}), "asset", "t", "~margin", "~nig", "~agree"),
    _op("MET25_confidence_informativeness", (*_SIGNAL, {"conf": "abs(score)", "err": "abs(score - actual)"}, spearman("conf", "err", "asset")), "asset", "n", "~ic"),
    _op("MET27_range_baseline", ({"pos": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "f": f"lead(close) {LAG}", "one": "1"}, "SELECT * FROM $in WHERE f IS NOT NULL", _BOUNDS, {"y": "CASE WHEN f > close THEN 1 ELSE 0 END", "side": "CASE WHEN t <= train_end THEN 'train' ELSE 'test' END"}, {"rk": tie_rank("pos", "side")}, "SELECT side, (sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1e0) / 2) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) AS auc FROM $in GROUP BY side", {"train_auc": "max(CASE WHEN side = 'train' THEN auc END) OVER ()"}, {"signed": "CASE WHEN train_auc < 0.5 THEN 1 - auc ELSE auc END"}), "side", "~auc", "~signed"),
    _op("MET30_ridge_skill", (*_SIGNAL, {"mean3": f"avg(score) {last(3)}"}, "SELECT count(*) AS n, sum(score * score) + 1 AS a, sum(score * mean3) AS b, sum(mean3 * mean3) + 1 AS d, sum(score * actual) AS u, sum(mean3 * actual) AS v FROM $in", {"det": "a * d - b * b"}, {"w1": "(d * u - b * v) / det", "w2": "(a * v - b * u) / det"}), "n", "~w1", "~w2"),
    _op("MET33_accuracy_report", (*_PROB, {"rk": tie_rank("p", "asset")}, "SELECT asset, count(*) AS n, avg(CASE WHEN (p > 0.5 AND y = 1) OR (p <= 0.5 AND y = 0) THEN 1e0 ELSE 0e0 END) AS acc, (sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1e0) / 2) / nullif(sum(y) * CAST(sum(1 - y) AS DOUBLE), 0) AS auc FROM $in GROUP BY asset"), "asset", "n", "~acc", "~auc"),
    _op("MET34_price_predictions", (*_NEXT, {"naive": f"close * close / {lag('close')}", "err": "1e0"}, "SELECT * FROM $in WHERE naive IS NOT NULL", {"err_pct": "100 * (naive - f) / f"}), "asset", "t", "~naive", "~err_pct"),
    _op("MET37_quantile_rearrangement", ({"a": "open", "b": "close", "c": "(high + low) / 2"}, {"lo": "least(a, b, c)", "hi": "greatest(a, b, c)", "crossed": "CASE WHEN a > b OR b > c THEN 1 ELSE 0 END"}, {"mid": "a + b + c - lo - hi"}), "asset", "t", "~lo", "~mid", "~hi", "crossed"),
    _op("MET38_train_deciles", (*_SIGNAL, _BOUNDS, *_edges("score", 10, "t <= train_end")), "asset", "t", "bucket"),
    _op("MET40_conformal_deciles", (*_SIGNAL, {"y": "abs(actual) / (0.01 + abs(score))", "b": "CAST(least(floor(abs(score) * 2), 4) AS BIGINT)"}, {"k": "row_number() OVER (PARTITION BY b ORDER BY y)", "n": "count(*) OVER (PARTITION BY b)"}, "SELECT b, max(n) AS n, max(CASE WHEN k = least(ceil((n + 1) * 0.9e0), n) THEN y END) AS hi, max(CASE WHEN k = greatest(floor((n + 1) * 0.1e0), 1) THEN y END) AS lo FROM $in GROUP BY b"), "b", "n", "~hi", "~lo"),
    _op("MET45_deflated_sharpe", (*_SIGNAL, "SELECT t, avg(actual * sign(score)) AS x FROM $in GROUP BY t", {"d": "x - avg(x) OVER ()", "m": "avg(x) OVER ()"}, "SELECT count(*) AS n, max(m) AS m, sqrt(avg(d * d)) AS sd, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM $in", {"sr": "m / sd", "skew": "m3 / (sd * sd * sd)", "kurt": "m4 / (sd * sd * sd * sd)"}, {"z": f"(sr - {_TRIALS!r} / sqrt(n)) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)"}), "n", "~sr", "~skew", "~kurt", "~z"),
    _op("BST10_design_effect", (*_SIGNAL, "SELECT t, avg(actual) AS x FROM $in GROUP BY t", *_NW, "SELECT count(*) AS n, (sum(d * d) + 2 * (2 / 3e0 * sum(d * d1) + 1 / 3e0 * sum(d * d2))) / sum(d * d) AS raw FROM $in", {"deff": "least(greatest(raw, 1), n)"}, {"effective": "n / deff"}), "n", "~deff", "~effective"),
    _op("BST11_paired_arms", (*_SIGNAL, *_DIFF, *_NW, "SELECT count(*) AS n, max(m) AS diff, sqrt(greatest(sum(d * d) + 2 * (2 / 3e0 * sum(d * d1) + 1 / 3e0 * sum(d * d2)), 0)) / count(*) AS se FROM $in", {"tstat": "diff / nullif(se, 0)"}), "n", "~diff", "~se", "~tstat"),
    _op("SIM02_predicted_rooms", (*_BRACKET, {"tp_room": "CASE WHEN dir = 0 THEN NULL ELSE fav END", "sl_room": "CASE WHEN dir = 0 THEN NULL ELSE adv END", "asym": "up - dn"}), "asset", "t", "~tp_room", "~sl_room", "~asym"),
    _op("SIM06_triggers", ({"mid": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20), "top": full("max", "high", 20, prior(20)), "slow": full("avg", "close", 50)}, {"upper": "mid + 2 * sd"}, {"bb_break": f"CASE WHEN close > upper AND {lag('close')} <= {lag('upper')} THEN 1 ELSE 0 END", "donchian": f"CASE WHEN close > top AND {lag('close')} <= {lag('top')} THEN 1 ELSE 0 END", "pullback": "CASE WHEN low < mid AND close > mid AND close > slow THEN 1 ELSE 0 END"}), "asset", "t", "bb_break", "donchian", "pullback", mapping="B2"),
    Scan("SIM05_trade_engine", ({"up": f"CASE WHEN close > {lag('close')} AND {lag('close')} > {lag('close', 2)} THEN 1 ELSE 0 END", "rng": f"avg(high - low) {last(3)}", "next_t": f"lead(t) {LAG}"}, {"sig": f"coalesce({lag('up')}, 0)", "atr": f"coalesce({lag('rng')}, 0)", "final": "CASE WHEN next_t IS NULL THEN 1 ELSE 0 END"}), ("open", "high", "low", "close", "sig", "atr", "final"),
         {"pos": ("0", f"CASE WHEN {_IN} AND ({_EXIT}) IS NULL THEN 1 ELSE 0 END"), "entry": ("NULL", f"CASE WHEN {_IN} THEN {_AT} END"), "risk": ("NULL", f"CASE WHEN {_IN} THEN {_RISK} END"), "age": ("0", f"CASE WHEN {_IN} THEN {_AGE} ELSE 0 END"), "fill": ("NULL", _EXIT)}, ("pos", "entry", "age", "fill"), "B3"),
    _op("SCL04_dates", ("SELECT DISTINCT t FROM $in", {"d": "CAST(TODATE(t) AS STRING)", "y": "CAST(year(TODATE(t)) AS BIGINT)", "m": "CAST(month(TODATE(t)) AS BIGINT)"}), "t", "d", "y", "m"),
    _op("SCL05_hashes", ("SELECT DISTINCT asset FROM $in", {"long_hash": "SHA(asset)", "short_hash": "md5(asset)"}), "asset", "long_hash", "short_hash"),
    _op("STD04_baseline_scores", ({"reversal": f"-(close / {lag('close')} - 1)", "wicks": "coalesce((least(open, close) - low - high + greatest(open, close)) / nullif(high - low, 0), 0)"},), "asset", "t", "~reversal", "~wicks"),
    _op("STD05_median_gates", (*_SIGNAL, _BOUNDS, _scalar("PCTL(abs(score), 0.5) AS med", "t > train_end + 2 AND t <= val_end"), "SELECT * FROM $in WHERE abs(score) >= med"), "asset", "t", "~score"),
    _op("STD06_coverage_threshold", (*_SIGNAL, _scalar("PCTL(abs(score), 0.8) AS cut"), "SELECT asset, count(*) AS n, avg(actual * sign(score)) AS mean FROM $in WHERE abs(score) >= cut GROUP BY asset"), "asset", "n", "~mean"),
    _op("STD02_split_errors", (*_SIGNAL, *_SPLITS, {"err": "abs(score - actual)"}, "SELECT part, count(*) AS n, avg(err) AS mae, PCTL(err, 0.9) AS p90 FROM $in GROUP BY part"), "part", "n", "~mae", "~p90"),
    _op("AGG23_coverage_tables", (*_SIGNAL, {"lvl": "CASE WHEN abs(score) < 0.5 THEN 'low' WHEN abs(score) < 1 THEN 'mid' ELSE 'high' END", "wk": "CAST(floor(t / 7e0) AS BIGINT)", "hit": "CASE WHEN abs(actual) <= abs(score) THEN 1e0 ELSE 0e0 END"}, "SELECT coalesce(lvl, '*') AS lvl, coalesce(wk, -1) AS wk, count(*) AS n, avg(hit) AS coverage FROM $in GROUP BY GROUPING SETS ((lvl, wk), (lvl), (wk), ())"), "lvl", "wk", "n", "~coverage"),
    _op("MET29_effective_sample", ({"r": f"ln(close) - {lag('ln(close)')}"}, "SELECT t, sum(r) AS s, sum(r * r) AS q, count(r) AS n FROM $in WHERE r IS NOT NULL GROUP BY t", "SELECT count(*) AS steps, avg(n) AS width, (sum(s * s) - sum(q)) / nullif(sum(n * (n - 1e0)), 0) / nullif(sum(q) / sum(n), 0) AS rho FROM $in", {"effective": "floor(steps / 3e0) * width / (1 + (width - 1) * greatest(rho, 0))"}), "steps", "~width", "~rho", "~effective"),
    _op("MET39_monthly_ic", (*_SIGNAL, {"m": "CAST(floor(t / 30e0) AS BIGINT)"}, spearman("score", "actual", "m"), {"accepted": "CASE WHEN ic < -0.1 THEN 1 ELSE 0 END"}), "m", "n", "~ic", "accepted"),
    _op("STD01_clustered_mean", (*_SIGNAL, {"x": "actual * sign(score)"}, _scalar("avg(x) AS m, count(*) AS total"), "SELECT max(total) AS n, max(m) AS mean, sqrt(sum(g * g)) / max(total) AS se FROM (SELECT t, max(total) AS total, max(m) AS m, sum(x - m) AS g FROM $in GROUP BY t) q", {"tstat": "mean / se"}), "n", "~mean", "~se", "~tstat"),
]
