"""Rolling, expanding and forward window operators of one asset's bars."""

from __future__ import annotations

import math

from .core import EVER, LAG, Operator, ahead, full, full2, lag, last, prior

_RET = {"ret": f"100 * (ln(close) - {lag('ln(close)')})"}
_R1 = {"r": f"ln(close) - {lag('ln(close)')}"}
_TR = {"tr": f"CASE WHEN {lag('close')} IS NULL THEN NULL ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"}
_YZ = 0.34 / (1.34 + 21 / 19)


def _op(name: str, stages: tuple, *out: str, mapping: str = "B2") -> Operator:
    return Operator(name, stages, ("asset", "t", *out), mapping)


def _zscore(x: str, n: int) -> str:
    return f"({x} - {full('avg', x, n)}) / nullif({full('stddev_samp', x, n)}, 0)"


def _range_var(name: str, term: str, n: int = 20) -> Operator:
    return _op(name, ({"term": term}, {"v": f"coalesce(sqrt(greatest({full('avg', 'term', n)}, 0)), 0)"}), "~v")


WINDOWS = [
    _op("WIN01_return_log_pct", ({f"ret_{h}": f"100 * (ln(close) - {lag('ln(close)', h)})" for h in (1, 5, 20)},), "~ret_1", "~ret_5", "~ret_20"),
    _op("WIN02_range_rel", ({"range_rel": "100 * (high - low) / close"},), "~range_rel"),
    _op("WIN03_candle_structure", ({"body": "coalesce((close - open) / nullif(high - low, 0), 0)", "wick_upper": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "wick_lower": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)"},), "~body", "~wick_upper", "~wick_lower"),
    _op("WIN04_position_in_range", ({"lo": full("min", "low", 50), "hi": full("max", "high", 50)}, {"pos": "coalesce((close - lo) / nullif(hi - lo, 0), 0.5)"}), "~pos"),
    _op("WIN05_volatility_ratio", (_RET, {"s": full("stddev_samp", "ret", 5), "l": full("stddev_samp", "ret", 20)}, {"volr": "coalesce(ln(nullif(s, 0) / nullif(l, 0)), 0)"}), "~volr"),
    _op("WIN06_volume_zscore", ({"lv": "ln(1 + volume)"}, {"volz": f"coalesce({_zscore('lv', 20)}, 0)"}), "~volz"),
    _op("WIN07_seasonality", ({"hour_sin": "sin(2 * pi() * (t % 24) / 24)", "hour_cos": "cos(2 * pi() * (t % 24) / 24)", "dow": "(CAST(floor(t / 24.0) AS BIGINT) + 3) % 7"}, {"dow_sin": "sin(2 * pi() * dow / 7)", "dow_cos": "cos(2 * pi() * dow / 7)"}), "~hour_sin", "~hour_cos", "dow", "~dow_sin", "~dow_cos", mapping="A2"),
    _op("WIN08_fractals", ({"mid_high": lag("high", 2), "mid_low": lag("low", 2), "hi": full("max", "high", 5), "lo": full("min", "low", 5)}, {"fractal_up": "CASE WHEN mid_high = hi THEN 1 ELSE 0 END", "fractal_down": "CASE WHEN mid_low = lo THEN 1 ELSE 0 END"}), "fractal_up", "fractal_down"),
    _range_var("WIN09_parkinson", "pow(ln(high / low), 2) / (4 * ln(2))"),
    _range_var("WIN10_garman_klass", "greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0)"),
    _range_var("WIN11_rogers_satchell", "greatest(ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)), 0)"),
    _op("WIN12_yang_zhang", ({"o": f"ln(open / {lag('close')})", "c": "ln(close / open)", "rs": "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)"}, {"v": f"{full('var_samp', 'o', 20)} + {_YZ} * {full('var_samp', 'c', 20)} + {1 - _YZ} * {full('avg', 'rs', 20)}"}, {"yz": "coalesce(sqrt(greatest(v, 0)), 0)"}), "~yz"),
    _op("WIN13_amihud", (_R1, {"x": "abs(r) / nullif(volume * close, 0) * 1000000"}, {"amihud": f"coalesce({full('avg', 'x', 20)}, 0)"}), "~amihud"),
    _op("WIN14_roll_spread", ({"dp": f"close - {lag('close')}"}, {"dq": lag("dp")}, {"n": f"count(dp) {last(20)}", "cov": f"covar_samp(dp, dq) {last(19)}"}, {"roll": "CASE WHEN n = 20 THEN sqrt(greatest(-cov, 0)) ELSE 0 END"}), "~roll"),
    _op("WIN15_variance_ratio", (_R1, {"q": full("sum", "r", 5)}, {"vq": full("var_samp", "q", 16), "v1": full("var_samp", "r", 20)}, {"vr": "coalesce(vq / nullif(5 * v1, 0), 1)"}), "~vr"),
    _op("WIN16_hurst", (_R1, {f"s{k}": full("sum", "r", k) for k in (1, 2, 4, 8)}, {f"v{k}": f"ln(nullif({full('var_samp', f's{k}', 32 - k + 1)}, 0))" for k in (1, 2, 4, 8)}, {"hurst": f"coalesce(0.5 * ((0 - 1.5) * v1 + (1 - 1.5) * v2 + (2 - 1.5) * v4 + (3 - 1.5) * v8) / (5 * {math.log(2)!r}), 0.5)"}), "~hurst"),
    _op("WIN17_jump_ratio", (_R1, {"bp": f"abs(r) * abs({lag('r')})"}, {"rv": full("sum", "r * r", 20), "bv": f"pi() / 2 * 20 / 19.0 * sum(bp) {last(19)}"}, {"jump": "coalesce(least(greatest((rv - bv) / nullif(rv, 0), 0), 1), 0)"}), "~jump"),
    _op("WIN19_bars_since", ({"rn": f"row_number() {LAG}", "hi": full("max", "high", 20)}, {"flag": "CASE WHEN high = hi THEN rn END"}, {"age": f"least(coalesce(rn - max(flag) {EVER}, 20), 200)"}), "age"),
    _op("WIN20_direction_consistency", (_R1, {"same": f"CASE WHEN {lag('r')} IS NULL THEN NULL WHEN sign(r) = sign({lag('r')}) THEN 1e0 ELSE 0e0 END"}, {"consistency": f"coalesce({full('avg', 'same', 20)}, 0.5)"}), "~consistency"),
    _op("WIN21_volatility_asymmetry", (_R1, {"up": "CASE WHEN r > 0 THEN r * r WHEN r IS NOT NULL THEN 0e0 END", "dn": "CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0e0 END"}, {"u": full("avg", "up", 20), "d": full("avg", "dn", 20)}, {"asym": "coalesce((d - u) / nullif(d + u, 0), 0)"}), "~asym"),
    _op("WIN22_crash_rebound", ({"n": f"count(close) {last(60)}", "top": f"max(close) {last(60)}"}, {"dd": "CASE WHEN n >= 30 THEN close / top - 1 END"}, {"regime": f"CASE WHEN min(dd) {last(10)} <= -0.2 THEN 1 ELSE 0 END"}), "~dd", "regime"),
    _op("WIN23_risk_adjusted_momentum", (_RET, {"ram": f"coalesce({full('avg', 'ret', 20)} / nullif({full('stddev_samp', 'ret', 20)}, 0), 0)"}), "~ram"),
    _op("WIN24_distance_from_ath", ({"rn": f"row_number() {LAG}", "ath": f"max(close) {EVER}"}, {"top": "CASE WHEN close = ath THEN rn END"}, {"dist": "close / ath - 1", "age": f"rn - max(top) {EVER}"}), "~dist", "age"),
    _op("WIN25_volatility_term", (_TR, {"x": "tr / close"}, {"term": f"coalesce({full('avg', 'x', 3)} / nullif({full('avg', 'x', 30)}, 0), 1)"}), "~term"),
    _op("WIN26_true_range", ({**_TR, "tr_first": f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))"},), "~tr", "~tr_first"),
    _op("WIN30_bollinger_pop", ({"mid": full("avg", "close", 20), "sd": full("stddev_pop", "close", 20)}, {"upper": "mid + 2 * sd", "lower": "mid - 2 * sd", "pct_b": "(close - mid + 2 * sd) / nullif(4 * sd, 0)", "width": "4 * sd / mid"}), "~mid", "~upper", "~lower", "~pct_b", "~width"),
    _op("WIN31_bollinger_donchian", ({"mid": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20), "don_hi": full("max", "high", 20, prior(20)), "don_lo": full("min", "low", 20, prior(20))}, {"upper": "mid + 2 * sd", "lower": "mid - 2 * sd"}), "~upper", "~lower", "~don_hi", "~don_lo"),
    _op("WIN32_donchian_grid", ({"hi55": full("max", "high", 55, prior(55)), "lo20": full("min", "low", 20, prior(20)), "sma50": full("avg", "close", 50)},), "~hi55", "~lo20", "~sma50"),
    _op("WIN33_squeeze_and_volume_median", (_TR, {"mid": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20), "atr": full("avg", "tr", 20), "vmed": f"CASE WHEN count(volume) {prior(20)} = 20 THEN PCTL(volume, 0.5) {prior(20)} END"}, {"in_kc": "CASE WHEN sd IS NULL OR atr IS NULL THEN 0 WHEN 2 * sd < 1.5 * atr THEN 1 ELSE 0 END"}, {"squeeze": f"coalesce({lag('in_kc')}, 0)"}), "squeeze", "~vmed"),
    _op("WIN34_williams_r", ({"hh": full("max", "high", 14), "ll": full("min", "low", 14)}, {"willr": "-100 * (hh - close) / nullif(hh - ll, 0)"}), "~willr"),
    _op("WIN35_cross_state", ({"f": full("avg", "close", 5), "s": full("avg", "close", 20)}, {"d": "f - s"}, {"c": f"CASE WHEN d > 0 AND {lag('d')} <= 0 THEN 1 WHEN d < 0 AND {lag('d')} >= 0 THEN -1 WHEN d IS NOT NULL AND {lag('d')} IS NOT NULL THEN 0 END"}, {"state": f"CASE WHEN count(c) {last(3)} = 3 THEN coalesce(nullif(c, 0), nullif({lag('c')}, 0), nullif({lag('c', 2)}, 0), 0) END"}), "state"),
    _op("WIN36_alignment", ({"a": full("avg", "close", 5), "b": full("avg", "close", 20), "c": full("avg", "close", 50)}, {"state": "CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL WHEN a > b AND b > c THEN 1 WHEN a < b AND b < c THEN -1 ELSE 0 END"}), "state"),
    _op("WIN37_zone_states", ({"hh": full("max", "high", 14), "ll": full("min", "low", 14)}, {"x": "100 * (close - ll) / nullif(hh - ll, 0)"}, {"zone": "CASE WHEN x IS NULL THEN NULL WHEN x < 20 THEN -1 WHEN x > 80 THEN 1 ELSE 0 END", "bucket": "CASE WHEN x IS NULL THEN NULL WHEN x < 25 THEN -1 WHEN x < 50 THEN 0 WHEN x < 75 THEN 1 ELSE 2 END"}), "zone", "bucket"),
    _op("WIN38_state_sum", ({"a": f"sign(close - {lag('close')})", "b": f"sign(close - {lag('close', 5)})", "c": f"sign(close - {full('avg', 'close', 20)})"}, {"trend": "CAST(a + b + c AS BIGINT)"}), "trend"),
    _op("WIN39_trailing_sigma", (_R1, {"sigma": f"greatest({full('stddev_samp', 'r', 20, prior(20))}, 0.0001)"}, {"s": f"CASE WHEN count(r) {prior(20)} = 20 THEN sigma END"}), "~s"),
    _op("WIN40_log_vs_prev_close", ({c: f"coalesce(ln({c0} / {lag('close')}), 0)" for c, c0 in (("lo", "open"), ("lh", "high"), ("ll", "low"), ("lc", "close"))},), "~lo", "~lh", "~ll", "~lc"),
    _op("WIN41_reference_returns", ("SELECT a.asset, a.t, a.close, b.close AS ref FROM $in a LEFT JOIN $in b ON a.t = b.t AND b.asset = 'NO'", {"ref_ret": f"ref / {lag('ref')} - 1"}, {"ref_lag2": lag("ref_ret", 2)}), "~ref_ret", "~ref_lag2"),
    _op("WIN42_corr_beta", ("SELECT a.asset, a.t, a.close, b.close AS ref FROM $in a LEFT JOIN $in b ON a.t = b.t AND b.asset = 'NO'", {"x": f"close / {lag('close')} - 1", "m": f"ref / {lag('ref')} - 1"}, {"v": full("var_samp", "m", 20), "sx": full("stddev_samp", "x", 20), "cov": full2("covar_samp", "x", "m", 20)}, {"corr": "CASE WHEN asset = 'NO' THEN 0 ELSE coalesce(cov / nullif(sx * sqrt(v), 0), 0) END", "beta": "CASE WHEN asset = 'NO' THEN 0 ELSE coalesce(cov / nullif(v, 0), 0) END"}), "~corr", "~beta"),
    _op("WIN43_event_zscore", ({"n": f"count(volume) {last(30)}", "m": f"avg(volume) {last(30)}", "s": f"stddev_samp(volume) {last(30)}"}, {"z": "CASE WHEN n >= 10 THEN coalesce((volume - m) / nullif(s, 0), 0) ELSE 0 END"}), "~z", mapping="A"),
    _op("WIN44_log_difference", ({"chg": f"ln(volume) - {lag('ln(volume)')}"},), "~chg"),
    _op("WIN45_past_zscore", ({"m": full("avg", "volume", 20, prior(20)), "s": full("stddev_samp", "volume", 20, prior(20))}, {"z": "greatest(least((volume - m) / nullif(s, 0), 10), -10)"}, {"zz": "CASE WHEN m IS NULL OR s = 0 THEN NULL ELSE z END"}), "~zz"),
    _op("WIN46_past_volatility", (_R1, {"own": f"CASE WHEN count(r) {prior(20)} >= 5 THEN stddev_samp(r) {prior(20)} END"}, "SELECT s.*, g.med FROM $in s LEFT JOIN (SELECT t, PCTL(own, 0.5) AS med FROM $in GROUP BY t) g ON s.t = g.t", "SELECT s.*, g.med AS overall FROM (SELECT asset, t, own, med FROM $in) s CROSS JOIN (SELECT PCTL(own, 0.5) AS med FROM $in) g", {"pvol": "coalesce(own, med, overall)"}), "~pvol"),
    _op("WIN47_rolling_quantiles", ({"x": "(high - low) / close"}, {f"q{p}": f"CASE WHEN count(x) {last(30)} = 30 THEN PCTL(x, 0.{p}) {last(30)} END" for p in (10, 50, 90)}), "~q10", "~q50", "~q90"),
    _op("WIN48_forward_targets", ({"next_range": f"lead((high - low) / close) {LAG}", "next_up": f"lead(high) {LAG} / close - 1", "next_down": f"1 - lead(low) {LAG} / close", "fwd": f"ln(lead(close, 6) {LAG}) - ln(lead(close, 1) {LAG})"},), "~next_range", "~next_up", "~next_down", "~fwd"),
    _op("WIN50_tsmom_weights", (_R1, {f"m{h}": f"CASE WHEN {lag('close', h)} IS NULL THEN NULL WHEN close > {lag('close', h)} THEN 1e0 ELSE 0e0 END" for h in (5, 20, 60)} | {"sd": full("stddev_samp", "r", 30)}, {"live": "CASE WHEN m60 IS NOT NULL AND sd > 0 THEN 1 ELSE 0 END"}, {"n": "sum(live) OVER (PARTITION BY t)"}, {"w": "CASE WHEN live = 1 THEN (m5 + m20 + m60) / 3 * least(0.02 / sd, 3) / n ELSE 0 END"}), "~w"),
    _op("WIN51_intraday_lag", ({"day": "CAST(floor(t / 24.0) AS BIGINT)"}, {"r": "ln(close / coalesce(lag(close) OVER (PARTITION BY asset, day ORDER BY t), open))"}), "~r", mapping="A2"),
    _op("WIN52_drawdown_streaks", (_R1, {"e": f"exp(sum(coalesce(r, 0)) {EVER})", "win": "CASE WHEN coalesce(r, 0) >= 0 THEN 1 ELSE 0 END"}, {"dd": f"e / max(e) {EVER} - 1", "g": f"sum(win) {EVER}"}, {"streak": "row_number() OVER (PARTITION BY asset, g ORDER BY t) - max(win) OVER (PARTITION BY asset, g)"}), "~dd", "streak"),
    _op("WIN54_lag_scan", ("SELECT asset, t, close AS x, " + ", ".join(f"{'lag' if k > 0 else 'lead'}(open, {abs(k)}) {LAG} AS p{k + 5}" for k in range(-5, 6)) + " FROM $in", "SELECT asset, CAST(count(*) AS BIGINT) AS t, " + ", ".join(f"corr(x, p{k}) AS c{k}" for k in range(11)) + " FROM $in GROUP BY asset"), *[f"~c{k}" for k in range(11)]),
    _op("WIN55_momentum_baseline", ({"d": f"sign(close - {lag('close')})"}, {"hit": f"CASE WHEN d IS NULL OR {lag('d')} IS NULL THEN NULL WHEN d = {lag('d')} THEN 1e0 ELSE 0e0 END"}, "SELECT asset, count(hit) AS t, avg(hit) AS accuracy FROM $in GROUP BY asset"), "~accuracy"),
    # arrays over a frame
    _op("WIN27_share_rank", ({"xs": f"LISTOF(close) {last(20)}"}, {"share": "CASE WHEN LEN(xs) = 20 THEN LEN(KEEP(xs; x <= close)) / 20e0 END"}), "~share", mapping="A"),
    _op("WIN28_mean_abs_deviation", ({"xs": f"LISTOF(close) {last(10)}", "m": f"avg(close) {last(10)}"}, {"mad": "CASE WHEN LEN(xs) = 10 THEN TOTAL(xs; abs(x - m)) / 10e0 END"}), "~mad", mapping="A"),
    _op("WIN29_rolling_pct_rank", ({"xs": f"LISTOF(close) {last(20)}"}, {"pct": "CASE WHEN LEN(xs) = 20 THEN (LEN(KEEP(xs; x < close)) + (LEN(KEEP(xs; x = close)) + 1) / 2e0) / 20e0 END"}), "~pct", mapping="A"),
    _op("WIN53_pct_encode_decode", ({"first": f"first_value(close) {EVER}", "enc": f"coalesce(100 * (close / nullif({lag('close')}, 0) - 1), 0)"}, {"decoded": f"first * exp(sum(ln(1 + enc / 100)) {EVER})"}, {"exact": "CASE WHEN abs(decoded / close - 1) < 0.000001 THEN 1 ELSE 0 END"}), "~enc", "exact"),
    _op("SMP05_forward_aggregates", ({"future_close": f"lead(close, 5) {LAG}", "future_low_min": f"CASE WHEN count(low) {ahead(5)} = 5 THEN min(low) {ahead(5)} END", "future_high_max": f"CASE WHEN count(high) {ahead(5)} = 5 THEN max(high) {ahead(5)} END"},), "~future_close", "~future_low_min", "~future_high_max"),
]
