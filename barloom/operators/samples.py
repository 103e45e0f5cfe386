"""Windows as arrays: normalised by kind, as samples and as recurrences; wide feature sets and multi-horizon cross-sections."""

from __future__ import annotations

from ..functions.normalize import window_stages
from .core import ACROSS, LAG, full, lag, last
from .cross_section import tie_rank
from .relational import _BOUNDS, _PROB, _SIGNAL, _op

#: One feature of each kind.
FEATURES = {
    "close": "close", "ATR_1": "high - low", "NATR_1": "100 * (high - low) / close", "RSI_1": "CASE WHEN high > low THEN 100 * (close - low) / (high - low) END", "CMO_1": "CASE WHEN high > low THEN 100 * (close - open) / (high - low) END",
    "WILLR_1": "CASE WHEN high > low THEN -100 * (high - close) / (high - low) END", "BOP_1": "CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END", "POS_1": "CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END",
    "ZS_1": "ln(volume)", "RET_1": "r", "OBV": "sum(sign(coalesce(r, 0)) * volume) OVER (PARTITION BY asset ORDER BY t)", "volume": "volume", "ITD_TRADES_LOG": "ln(trades)", "X_available": "CASE WHEN trades > 1 THEN 1 ELSE 0 END",
    "FUND_rate": "r / 1000", "unknown": "trades",
}
WINDOW = 8
_W = last(WINDOW)


def _digest(names) -> dict[str, str]:
    """First and last value and sum of squares of each window."""
    out = {}
    for n in names:
        out |= {f"{n}_a": f"AT(w_{n}; 1)", f"{n}_z": f"AT(w_{n}; {WINDOW})", f"{n}_q": f"TOTAL(w_{n}; x * x)"}
    return out


def _flat(names) -> list[str]:
    return [f"~{n}_{c}" for n in names for c in "azq"]


_NAMED = {f"e{i}": e for i, e in enumerate(FEATURES.values())}
_R = {"r": f"ln(close) - {lag('ln(close)')}"}
_HORIZONS = (1, 3, 6)
_XS = "PARTITION BY t"


def _robust(h: int) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    size = f"1.4826 * PCTL(abs(r{h}), 0.5) {last(12)}"
    known = f"count(r{h}) {last(12)} = 12"
    return (
        {f"g{h}": f"CASE WHEN {known} THEN {size} END", f"d{h}": f"CASE WHEN {known} THEN stddev_pop(r{h}) {last(12)} END"},
        {f"z{h}": f"CASE WHEN g{h} IS NOT NULL THEN greatest(least(r{h} / CASE WHEN g{h} >= 1e-8 THEN g{h} ELSE greatest(d{h}, 1e-8) END, 5), -5) END"},
        {f"q{h}": f"z{h} / CASE WHEN stddev_pop(z{h}) OVER ({_XS}) > 1e-8 THEN stddev_pop(z{h}) OVER ({_XS}) END"},
    )


def _merge(k: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for h in _HORIZONS:
        out |= _robust(h)[k]
    return out


def _z(x: str, n: int) -> str:
    return f"({x} - {full('avg', x, n)}) / nullif({full('stddev_samp', x, n)}, 0)"


#: The hourly panel's set over bars: volume stands for open interest, volume times close for its value, bar ratios for account ratios.
_PANEL = (
    {"l": "ln(close)", "oi": "ln(volume)", "oiv": "ln(volume * close)", "acc": "ln(high / low + 1)", "top": "ln(close / open)", "pos": "ln(trades)", "tk": "ln(greatest(least(close / low, 1000), 0.001))"},
    {"r": f"l - {lag('l')}"},
    {f"mom_{h}": f"l - {lag('l', h)}" for h in (1, 4, 24, 72, 168)} | {f"doi_{h}": f"oi - {lag('oi', h)}" for h in (1, 4, 24, 72)} | {f"{c}_d24": f"{c} - {lag(c, 24)}" for c in ("acc", "top", "pos")}
    | {f"vol{n}": f"CASE WHEN count(r) {last(n)} >= {m} THEN stddev_samp(r) {last(n)} END" for n, m in ((24, 18), (168, 120))}
    | {"hi168": f"l - {full('max', 'l', 168)}", "lo168": f"l - {full('min', 'l', 168)}", "hi720": f"l - {full('max', 'l', 720)}", "oi_z": _z("oiv", 720)}
    | {f"{c}_z": _z(c, 168) for c in ("acc", "top", "pos")} | {"tk_24": full("avg", "tk", 24), "smr": "pos - acc", "tk_mean": full("avg", "tk", 168), "tk_sd": full("stddev_samp", "tk", 168), "tk_4": full("avg", "tk", 4)},
    {"vol_ratio": "ln(nullif(vol24, 0) / nullif(vol168, 0))", "oi_to_px": "doi_24 - mom_24", "smr_d24": f"smr - {lag('smr', 24)}", "tk_z": "(tk_4 - tk_mean) / nullif(tk_sd, 0)", "cross24": "sign(mom_24) * doi_24", "size": "oiv"},
)
_PANEL_OUT = ["mom_1", "mom_4", "mom_24", "mom_72", "mom_168", "vol24", "vol168", "vol_ratio", "hi168", "lo168", "hi720", "doi_1", "doi_4", "doi_24", "doi_72", "oi_z", "oi_to_px", "acc", "acc_d24", "acc_z", "top", "top_d24", "top_z", "pos", "pos_d24", "pos_z", "smr", "smr_d24", "tk", "tk_24", "tk_z", "cross24", "size"]


def _fold_skill(share: float, k: int) -> str:
    """Fit on the latest ``share`` of the training steps, judged on validation by the moments of both."""
    return (
        f"SELECT {k} AS k, {share!r}e0 AS share, a.n, a.slope, b.cov * a.slope / nullif(sqrt(a.slope * a.slope * b.vx * b.vy), 0) AS skill FROM "
        f"(SELECT count(*) AS n, covar_pop(score, actual) / nullif(var_pop(score), 0) AS slope FROM $in WHERE t <= train_end AND t > train_end - {share!r} * (train_end - first_t + 1)) a "
        "CROSS JOIN (SELECT covar_pop(score, actual) AS cov, var_pop(score) AS vx, var_pop(actual) AS vy FROM $in WHERE t > train_end + 2 AND t <= val_end) b"
    )


_STATES = 8

SAMPLES = [
    _op("SMP01_sliding_window", ({f"w_{c}": f"LISTOF({c}) {last(16)}" for c in ("open", "high", "low", "close", "volume")}, "SELECT * FROM $in WHERE LEN(w_close) = 16 AND t % 2 = 0", {f"{c}_{k}": f"AT(w_{c}; {k})" for c in ("open", "high", "low", "close", "volume") for k in (1, 8, 16)} | {"total": "TOTAL(w_close; x)"}), "asset", "t", *[f"~{c}_{k}" for c in ("open", "high", "low", "close", "volume") for k in (1, 8, 16)], "~total"),
    _op("SMP13_window_normalisation", (_R, _NAMED, *window_stages(dict(zip(FEATURES, _NAMED, strict=True)), WINDOW, _W), _digest(FEATURES)), "asset", "t", *_flat(FEATURES)),
    _op(
        "XS03_orthogonal_momentum",
        (
            {f"r{h}": f"100 * (ln(close) - {lag('ln(close)', h)})" for h in _HORIZONS} | {"natr": full("avg", "(high - low) / close", 12)},
            _merge(0), _merge(1), _merge(2), {"mom": f"({' + '.join(f'q{h}' for h in _HORIZONS)}) / {len(_HORIZONS)}"},
            {"ok": "CASE WHEN mom IS NOT NULL AND natr IS NOT NULL THEN 1 ELSE 0 END"},
            {"n": f"sum(ok) {ACROSS}", "rm": f"CASE WHEN ok = 1 THEN {tie_rank('mom', 't, ok')} END", "rn": f"CASE WHEN ok = 1 THEN {tie_rank('natr', 't, ok')} END"},
            {"a": "rm / (n / 2e0)", "b": "rn / (n / 2e0)"},
            {"slope": f"covar_pop(a, b) {ACROSS} / nullif(var_pop(b) {ACROSS}, 0)", "ma": f"avg(a) {ACROSS}", "mb": f"avg(b) {ACROSS}"},
            {"res": "CASE WHEN ok = 1 AND n >= 5 THEN coalesce(a - ma - slope * (b - mb), 0) ELSE 0 END"},
        ),
        "asset", "t", "~mom", "~res", mapping="B3",
    ),
    _op("WIN49_panel_features", _PANEL, "asset", "t", *[f"~{c}" for c in _PANEL_OUT], mapping="B2"),
    _op(
        "REC14_oscillator_sweep",
        (
            {"d": f"close - {lag('close')}", "tp": "(high + low + close) / 3", "pc": lag("close")},
            {f"up{n}": full("avg", "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", n) for n in (7, 14)} | {f"dn{n}": full("avg", "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END", n) for n in (7, 14)} | {f"m{n}": full("avg", "tp", n) for n in (10, 20)} | {f"l{n}": f"LISTOF(tp) {last(n)}" for n in (10, 20)}
            | {f"bm{n}": full("avg", "close", n) for n in (10, 20)} | {f"sd{n}": full("stddev_pop", "close", n) for n in (10, 20)},
            {f"rsi_{n}": f"100 * up{n} / nullif(up{n} + dn{n}, 0)" for n in (7, 14)} | {f"cci_{n}": f"(tp - m{n}) / nullif(0.015 * TOTAL(l{n}; abs(x - m{n})) / {n}, 0)" for n in (10, 20)} | {f"bbm_{n}": f"(close - bm{n}) / nullif(2 * sd{n}, 0)" for n in (10, 20)},
            " UNION ALL ".join(f"SELECT asset, t, '{c}_{n}' AS name, {c}_{n} AS x FROM $in" for c, ns in (("rsi", (7, 14)), ("cci", (10, 20)), ("bbm", (10, 20))) for n in ns), "SELECT * FROM $in WHERE x IS NOT NULL",
        ),
        "asset", "t", "name", "~x", mapping="B2",
    ),
    _op(
        "REC13_price_indicators",
        (
            {"pc": lag("close"), "tp": "(high + low + close) / 3"},
            {"tr": "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))", "bp": "close - least(low, coalesce(pc, low))", "hh": full("max", "high", 14), "ll": full("min", "low", 14), "hl2": "(high + low) / 2"},
            {"k": "100 * (close - ll) / nullif(hh - ll, 0)"} | {f"u{n}": f"{full('sum', 'bp', n)} / nullif({full('sum', 'tr', n)}, 0)" for n in (7, 14, 28)} | {"mid": full("avg", "close", 20), "sd": full("stddev_pop", "close", 20), "don_hi": full("max", "high", 20), "don_lo": full("min", "low", 20), "roc": f"100 * (close / {lag('close', 10)} - 1)", "natr": f"100 * {full('avg', 'tr', 14)} / close", "log_return": "ln(close / pc)", "percent_return": "close / pc - 1"},
            {"stoch_d": full("avg", "k", 3), "uo": "100 * (4 * u7 + 2 * u14 + u28) / 7", "bb_hi": "mid + 2 * sd", "bb_lo": "mid - 2 * sd", "don_mid": "(don_hi + don_lo) / 2"},
        ),
        "asset", "t", "~k", "~stoch_d", "~uo", "~bb_hi", "~bb_lo", "~don_mid", "~roc", "~natr", "~log_return", "~percent_return", "~hl2", mapping="B2",
    ),
    # recurrence of the last states of two bars: pairs of states nearer than the 0.2 quantile of all pairs
    _op(
        "ML11_recurrence",
        (
            _R, {"s": f"stddev_samp(r) {last(20)}"}, {"z": "r / nullif(s, 0)"}, {"rn": f"row_number() {LAG}", "z1": lag("z")}, "SELECT * FROM $in WHERE z1 IS NOT NULL AND z IS NOT NULL",
            {f"p{k}": lag("z", k) for k in range(1, _STATES)} | {f"p{k}_1": lag("z1", k) for k in range(1, _STATES)}, f"SELECT * FROM $in WHERE p{_STATES - 1}_1 IS NOT NULL AND t % 5 = 0",
            f"SELECT asset, t, z, z1, SERIES(0, {_STATES - 1}) AS a, {', '.join(f'p{k}, p{k}_1' for k in range(1, _STATES))} FROM $in", f"SELECT *, SERIES(0, {_STATES - 1}) AS b FROM $in", "SELECT * FROM $in WHERE a < b",
            {f"{s}{c}": "CASE " + " ".join(f"WHEN {s} = {k} THEN {('z' if k == 0 else f'p{k}') if c == 'x' else ('z1' if k == 0 else f'p{k}_1')}" for k in range(_STATES)) + " END" for s in "ab" for c in "xv"},
            {"d": "sqrt((ax - bx) * (ax - bx) + (av - bv) * (av - bv))"}, {"eps": "PCTL(d, 0.2) OVER (PARTITION BY asset, t)"}, {"rec": "CASE WHEN d < eps THEN 1 ELSE 0 END"},
            "SELECT s.asset, s.t, s.a, s.b, s.rec, n.rec AS next_, p.rec AS prev_ FROM $in s LEFT JOIN $in n ON s.asset = n.asset AND s.t = n.t AND n.a = s.a + 1 AND n.b = s.b + 1 LEFT JOIN $in p ON s.asset = p.asset AND s.t = p.t AND p.a = s.a - 1 AND p.b = s.b - 1",
            "SELECT asset, t, CAST(sum(rec) AS BIGINT) AS recurrences, sum(CASE WHEN rec = 1 AND (next_ = 1 OR prev_ = 1) THEN 1e0 ELSE 0e0 END) / nullif(sum(rec), 0) AS determinism, sum(CASE WHEN a = 0 AND rec = 1 THEN 1e0 ELSE 0e0 END) / " + str(_STATES - 1) + " AS current_ FROM $in GROUP BY asset, t",
        ),
        "asset", "t", "recurrences", "~determinism", "~current_", mapping="B2",
    ),
    _op("MET31_learning_curve", (*_SIGNAL, _BOUNDS, "SELECT s.*, (SELECT min(t) FROM $in) AS first_t FROM $in s", " UNION ALL ".join(_fold_skill(f, k) for k, f in enumerate((0.25, 0.5, 1.0))), {"gain": "(skill - lag(skill) OVER (ORDER BY k)) / nullif(ln(n / CAST(lag(n) OVER (ORDER BY k) AS DOUBLE)) / ln(2), 0)"}, {"verdict": "CASE WHEN k < 2 THEN 'part' WHEN gain > 0.01 THEN 'more data' ELSE 'plateau' END"}), "share", "n", "~skill", "~gain", "verdict", mapping="A"),
    # the participation ratio of a covariance's eigenvalues, from its entries: their sum is the trace, their squares sum to the entries' squares
    _op(
        "MET43_norm_geometry",
        (
            {"a": "(close - open) / open", "b": "(high - low) / close", "c": f"close / {lag('close')} - 1", "d": "ln(1 + volume)"}, "SELECT * FROM $in WHERE c IS NOT NULL",
            "SELECT count(*) AS n, " + ", ".join(f"covar_samp({x}, {y}) AS {x}{y}, corr({x}, {y}) AS r{x}{y}" for i, x in enumerate("abcd") for y in "abcd"[i:]) + " FROM $in",
            {"eff_cov": "pow(aa + bb + cc + dd, 2) / (aa * aa + bb * bb + cc * cc + dd * dd + 2 * (ab * ab + ac * ac + ad * ad + bc * bc + bd * bd + cd * cd)) / 4", "eff_corr": "16e0 / (4 + 2 * (rab * rab + rac * rac + rad * rad + rbc * rbc + rbd * rbd + rcd * rcd)) / 4"},
        ),
        "n", "~eff_cov", "~eff_corr", mapping="A",
    ),
    _op(
        "STD16_trend_variants",
        (
            {"r": f"lead(close) {LAG} / close - 1"} | {f"m{n}": f"CASE WHEN {lag('close', n)} IS NULL THEN NULL WHEN close > {lag('close', n)} THEN 1e0 ELSE 0e0 END" for n in (10, 20, 30, 60)}, "SELECT * FROM $in WHERE m60 IS NOT NULL AND r IS NOT NULL",
            " UNION ALL ".join(f"SELECT t, asset, '{v}' AS variant, r, {w} AS w FROM $in" for v, w in (("base", "m30"), ("ensemble", "(m10 + m20 + m30 + m60) / 4"), ("fast exit", "m30 * m10"))),
            "SELECT variant, t, avg(w * r) AS x, avg(w) AS w FROM $in GROUP BY variant, t",
            {"sd": "stddev_pop(x) OVER (PARTITION BY variant)", "ref": "1"}, "SELECT s.*, g.ref_sd FROM (SELECT variant, t, x, w, sd FROM $in) s CROSS JOIN (SELECT max(CASE WHEN variant = 'base' THEN sd END) AS ref_sd FROM $in) g",
            {"y": "greatest(x * ref_sd / nullif(sd, 0), -0.99)", "own": "greatest(x, -0.99)"}, {"e": "sum(ln(1 + own)) OVER (PARTITION BY variant ORDER BY t)", "f": "sum(ln(1 + y)) OVER (PARTITION BY variant ORDER BY t)", "left_": "CASE WHEN w < lag(w) OVER (PARTITION BY variant ORDER BY t) THEN 1 ELSE 0 END", "past": "avg(x) OVER (PARTITION BY variant ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"},
            {"top": "max(e) OVER (PARTITION BY variant ORDER BY t)", "ftop": "max(f) OVER (PARTITION BY variant ORDER BY t)"},
            "SELECT variant, count(*) AS n, avg(x) / nullif(stddev_pop(x), 0) AS sharpe, min(exp(e - top) - 1) AS max_dd, min(exp(f - ftop) - 1) AS matched_dd, avg(CASE WHEN left_ = 1 THEN past END) AS give_back FROM $in GROUP BY variant",
        ),
        "variant", "n", "~sharpe", "~max_dd", "~matched_dd", "~give_back", mapping="B2",
    ),
    # one call: score, decode, evaluate, for each asset and over all
    _op(
        "STD18_predict_evaluate",
        (
            {"mu": f"close / {lag('close')} - 1", "actual": f"lead(close) {LAG} / close - 1", "entry": "close"}, "SELECT * FROM $in WHERE mu IS NOT NULL AND actual IS NOT NULL",
            {"pred": "entry * (1 + mu)", "true_": "entry * (1 + actual)"}, {"err": "abs(pred - true_)", "pct": "100 * abs(pred / true_ - 1)", "right_": "CASE WHEN sign(mu) = sign(actual) THEN 1e0 ELSE 0e0 END"},
            "SELECT coalesce(asset, '*') AS asset, count(*) AS n, avg(err) AS mae, avg(pct) AS mape, avg(right_) AS direction, corr(pred, true_) AS rho FROM $in GROUP BY GROUPING SETS ((asset), ())",
        ),
        "asset", "n", "~mae", "~mape", "~direction", "~rho", mapping="B3",
    ),
    _op("STD19_evaluation_bridge", (*_PROB, _BOUNDS, "SELECT asset, count(*) AS n, min(t) AS from_t, max(t) AS to_t, avg(p) AS p_up, 1 AS reg_scale FROM $in WHERE t > val_end + 2 GROUP BY asset"), "asset", "n", "from_t", "to_t", "~p_up", "reg_scale"),
    _op("STD20_split_accessors", (*_SIGNAL, _BOUNDS, {"part": "CASE WHEN t <= train_end THEN 'train' WHEN t <= val_end THEN 'val' ELSE 'test' END"}, "SELECT part, count(*) AS n, count(DISTINCT asset) AS assets, min(t) AS from_t, max(t) AS to_t, PCTL(score, 0.5) AS center FROM $in GROUP BY part"), "part", "n", "assets", "from_t", "to_t", "~center"),
    _op("SPL12_split_names", (*_SIGNAL, _BOUNDS, {"row_": "row_number() OVER (PARTITION BY asset ORDER BY t)", "part": "CASE WHEN t <= train_end THEN 'train' WHEN t > val_end THEN 'test' ELSE 'val' END"}, "SELECT part, asset, min(row_) AS start_, max(row_) + 1 AS end_ FROM $in GROUP BY part, asset"), "part", "asset", "start_", "end_"),
    _op("UDF04_group_transform", ({"med": "PCTL(close, 0.5) OVER (PARTITION BY t)"}, {"rel": "close / med"}), "asset", "t", "~med", "~rel", mapping="B3"),
    _op(
        "SIM09_hedged_recovery",
        (
            {"r": f"close / {lag('close')} - 1", "fwd": f"lead(close) {LAG} / close - 1", "trail": f"close / max(close) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) - 1"}, "SELECT * FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL",
            {"rn": "row_number() OVER (PARTITION BY t ORDER BY trail, asset)", "n": f"count(*) {ACROSS}", "mkt": f"avg(fwd) {ACROSS}"}, "SELECT * FROM $in WHERE n >= 5 AND rn <= 0.2e0 * n",
            {"leg": "CASE WHEN fwd < -0.3 THEN -0.3 WHEN fwd > 0.6 THEN 0.6 ELSE fwd END", "out_": "CASE WHEN fwd < -0.3 THEN 'stop' WHEN fwd > 0.6 THEN 'target' ELSE 'time' END"}, {"net": "leg - mkt - 0.0028"},
            "SELECT t, count(*) AS legs, avg(net) AS net, count(CASE WHEN out_ = 'stop' THEN 1 END) AS stops, count(CASE WHEN out_ = 'target' THEN 1 END) AS targets FROM $in GROUP BY t",
            {"e": "exp(sum(ln(greatest(1 + 0.1 * net, 0.01))) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"}, {"dd": "e / max(e) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1"},
        ),
        "t", "legs", "~net", "stops", "targets", "~e", "~dd", mapping="B3",
    ),
    # orders at the band's edge, then the first of target, stop and time over the next bars
    _op(
        "SIM10_pullback_paths",
        (
            {"lo": full("min", "low", 12), "hi": full("max", "high", 12)}, "SELECT * FROM $in WHERE lo IS NOT NULL",
            {f"h{k}": f"lead(high, {k}) {LAG}" for k in (1, 2, 3)} | {f"l{k}": f"lead(low, {k}) {LAG}" for k in (1, 2, 3)} | {"c3": f"lead(close, 3) {LAG}"}, "SELECT * FROM $in WHERE c3 IS NOT NULL",
            {"bid": "lo + 0.1 * (hi - lo)"}, "SELECT * FROM $in WHERE low <= bid AND close > bid",
            {"goal": "bid + 0.4 * (hi - lo)", "stop": "bid - 0.2 * (hi - lo)"},
            {f"hit{k}": f"CASE WHEN l{k} <= stop THEN 'stop' WHEN h{k} >= goal THEN 'goal' END" for k in (1, 2, 3)},
            {"how": "coalesce(hit1, hit2, hit3, 'time')"}, {"ret": "CASE how WHEN 'stop' THEN stop WHEN 'goal' THEN goal ELSE c3 END / bid - 1", "mfe": "greatest(h1, h2, h3) / bid - 1", "mae": "least(l1, l2, l3) / bid - 1"},
        ),
        "asset", "t", "how", "~ret", "~mfe", "~mae", mapping="B2",
    ),
]
