"""Operators against pandas, written apart from their SQL, and against themselves with the future changed."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.functions import normalize
from barloom.operators.recursions import RECURSIONS
from barloom.operators.relational import RELATIONAL
from barloom.operators.windows import WINDOWS
from barloom.plans.catalog import QUERIES
from barloom.sources.bars import bars

SF = "/root/testdata/sf0.001"


def _wilder(x, n):
    out, seed, held = [], [], None
    for v in x:
        if math.isnan(v):
            out.append(math.nan)
            continue
        if held is None:
            seed.append(v)
            held = sum(seed) / n if len(seed) == n else None
        else:
            held += (v - held) / n
        out.append(math.nan if held is None else held)
    return pd.Series(out, index=x.index)


def _true_range(g):
    pc = g.close.shift()
    return pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1).where(pc.notna())


def _kdj(g):
    lo, hi = g.low.rolling(9, min_periods=1).min(), g.high.rolling(9, min_periods=1).max()
    k = d = math.nan
    ks, ds = [], []
    for c, a, b in zip(g.close, lo, hi):
        rsv = 100 * (c - a) / (b - a) if b > a else math.nan
        k = (50 if math.isnan(k) else k) * 2 / 3 + rsv / 3
        d = math.nan if math.isnan(k) else (50 if math.isnan(d) else d) * 2 / 3 + k / 3
        ks.append(k)
        ds.append(d)
    return {"k": pd.Series(ks, index=g.index), "d": pd.Series(ds, index=g.index)}


def _cooldown(g):
    wait, kept = 0, []
    for event in (g.close < g.close.shift() * 0.8).tolist():
        hit = event and wait <= 0
        kept.append(float(hit))
        wait = 5 if hit else max(wait - 1, 0)
    return {"kept": pd.Series(kept, index=g.index)}


def _bollinger(g):
    mid, sd = g.close.rolling(20).mean(), g.close.rolling(20).std(ddof=0)
    return {"mid": mid, "upper": mid + 2 * sd, "lower": mid - 2 * sd}


def _volatility(g):
    r = 100 * np.log(g.close).diff()
    s, long = r.rolling(5).std(), r.rolling(20).std()
    return {"volr": np.log(s.where(s > 0) / long.where(long > 0)).fillna(0)}


LOG = lambda g: np.log(g.close)
EXPECTED = {
    "WIN01_return_log_pct": ("B2", lambda g: {f"ret_{h}": 100 * LOG(g).diff(h) for h in (1, 5, 20)}),
    "WIN05_volatility_ratio": ("B2", _volatility),
    "WIN06_volume_zscore": ("B2", lambda g: {"volz": ((v := np.log1p(g.volume)) - v.rolling(20).mean()).div(v.rolling(20).std()).fillna(0)}),
    "WIN09_parkinson": ("B2", lambda g: {"v": np.sqrt((np.log(g.high / g.low) ** 2 / (4 * math.log(2))).rolling(20).mean()).fillna(0)}),
    "WIN13_amihud": ("B2", lambda g: {"amihud": (LOG(g).diff().abs() / (g.volume * g.close) * 1e6).rolling(20).mean().fillna(0)}),
    "WIN23_risk_adjusted_momentum": ("B2", lambda g: {"ram": ((r := 100 * LOG(g).diff()).rolling(20).mean() / r.rolling(20).std()).fillna(0)}),
    "WIN24_distance_from_ath": ("B2", lambda g: {"dist": g.close / g.close.cummax() - 1}),
    "WIN27_share_rank": ("A", lambda g: {"share": g.close.rolling(20).apply(lambda x: (x <= x[-1]).mean(), raw=True)}),
    "WIN28_mean_abs_deviation": ("A", lambda g: {"mad": g.close.rolling(10).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)}),
    "WIN29_rolling_pct_rank": ("A", lambda g: {"pct": g.close.rolling(20).rank(pct=True)}),
    "WIN30_bollinger_pop": ("B2", _bollinger),
    "WIN34_williams_r": ("B2", lambda g: {"willr": -100 * (g.high.rolling(14).max() - g.close) / (g.high.rolling(14).max() - g.low.rolling(14).min())}),
    "WIN47_rolling_quantiles": ("B2", lambda g: {f"q{p}": ((g.high - g.low) / g.close).rolling(30).quantile(p / 100) for p in (10, 50, 90)}),
    "REC01_ema": ("B3", lambda g: {"ema": g.close.ewm(span=20, adjust=False).mean()}),
    "REC02_ewm_alpha": ("B3", lambda g: {"u": g.close.diff().clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), "d": (-g.close.diff()).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()}),
    "REC03_wilder": ("B3", lambda g: {"atr": _wilder(_true_range(g), 14)}),
    "REC05_rsi": ("B3", lambda g: {"u": _wilder(g.close.diff().clip(lower=0), 14), "d": _wilder((-g.close.diff()).clip(lower=0), 14)}),
    "REC06_macd": ("B3", lambda g: {"line": (m := g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()), "signal": m.ewm(span=9, adjust=False).mean()}),
    "REC07_kdj": ("B3", _kdj),
    "REC15_equity_fractional": ("B3", lambda g: {"equity": (1 + 0.0001 * (100 * g.close.pct_change()).fillna(0).clip(lower=-100)).cumprod()}),
    "FIL19_event_cooldown": ("B3", _cooldown),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matches_pandas(spark, name):
    mapping, make = EXPECTED[name]
    frame = bars(spark, SF, mapping).toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    found = QUERIES[name](spark, SF).toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    expected = pd.concat([pd.DataFrame(make(g)) for _, g in frame.groupby("asset")]).sort_index()
    assert len(found) == len(expected) and found["t"].tolist() == frame["t"].tolist()
    for column in expected:
        assert np.allclose(found[column].astype(float), expected[column].astype(float), atol=2e-5, rtol=1e-6, equal_nan=True), column


def test_cross_section_matches_pandas(spark):
    frame = bars(spark, SF, "B3").toPandas().sort_values(["asset", "t"])
    frame["r"] = np.log(frame.close).groupby(frame.asset).diff()
    frame["fwd"] = frame.groupby("asset").close.shift(-1) / frame.close - 1
    known = frame.dropna(subset=["r"]).copy()
    known["rank"] = known.groupby("t").r.rank(pct=True)
    found = QUERIES["XS01_momentum_rank"](spark, SF).toPandas().set_index(["asset", "t"])["rank"]
    assert np.allclose(found.sort_index(), known.set_index(["asset", "t"])["rank"].sort_index(), atol=2e-6)
    both = frame.dropna(subset=["r", "fwd"])
    ic = {t: g.r.rank().corr(g.fwd.rank()) for t, g in both.groupby("t") if len(g) >= 5}
    found = {r.t: r.ic for r in QUERIES["XS09_rank_ic"](spark, SF).collect()}
    assert found.keys() == ic.keys() and all(math.isclose(found[t], ic[t], abs_tol=2e-6) for t in ic if found[t] is not None)


#: These look ahead or at other assets on purpose.
_AHEAD = {"WIN41_reference_returns", "WIN42_corr_beta", "WIN46_past_volatility", "WIN48_forward_targets", "WIN50_tsmom_weights", "WIN52_drawdown_streaks", "WIN54_lag_scan", "WIN55_momentum_baseline", "SMP05_forward_aggregates"}


@pytest.mark.parametrize("op", [o for o in (*WINDOWS, *RECURSIONS) if o.name not in _AHEAD], ids=lambda o: o.name)
def test_no_look_ahead(spark, op):
    """Whatever happens from a step on, rows before it stay as they are."""
    rng, cut = np.random.default_rng(6), 90
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
    rows = pd.DataFrame({"asset": "x", "t": np.arange(120), "open": close * 1.001, "high": close * (1 + rng.random(120) / 50 + 0.002), "low": close * (1 - rng.random(120) / 50), "close": close, "volume": rng.random(120) * 900 + 10, "trades": rng.integers(1, 9, 120)})
    other = rows.assign(asset="y")
    late = other.t >= cut
    other.loc[late, ["open", "high", "low", "close", "volume"]] *= rng.random((int(late.sum()), 1)) * 5 + 0.1
    found = op(spark.createDataFrame(pd.concat([rows, other]))).toPandas().sort_values("t")
    a, b = (found[(found.asset == n) & (found.t < cut)].drop(columns="asset").reset_index(drop=True) for n in "xy")
    assert len(a) == len(b) > 0
    pd.testing.assert_frame_equal(a, b, check_exact=False, atol=1e-5)


def test_forward_targets_do_look_ahead(spark):
    """The same test finds an operator that looks ahead."""
    op = next(o for o in WINDOWS if o.name == "WIN48_forward_targets")
    with pytest.raises(AssertionError):
        test_no_look_ahead(spark, op)


def test_window_normalisation_by_hand(spark):
    """The 16 kinds on windows written out in numpy."""
    n = 8
    columns = {"close": "close", "ATR_1": "v", "NATR_1": "v", "RSI_1": "v", "CMO_1": "v", "WILLR_1": "v", "BOP_1": "v", "POS_1": "v", "ZS_1": "v", "RET_1": "v", "OBV": "v", "volume": "v", "ITD_TRADES_LOG": "v", "X_available": "flag", "FUND_rate": "flag", "EMA_5": "flag", "unknown": "v"}
    close, v = np.array([10, 11, 9, 12, 13, 12, 14, 15.0]), np.array([0.2, np.nan, -0.4, 0.1, 0.9, np.inf, 0.3, -0.2])
    rows = spark.createDataFrame([("a", i, float(close[i]), float(v[i]), 1.0) for i in range(n)], "asset string, t long, close double, v double, flag double")
    from barloom.operators.core import Operator, last

    names = {f"e{i}": e for i, e in enumerate(columns.values())}
    op = Operator("x", (names, *normalize.window_stages(dict(zip(columns, names)), n, last(n))), tuple(f"w_{c}" for c in columns))
    found = {c: np.array(x) for c, x in zip(columns, op(rows).first())}
    x = np.where(np.isfinite(v), v, np.median(v[np.isfinite(v)]))
    iqr = lambda a: max(np.quantile(a, 0.75) - np.quantile(a, 0.25), 0.001 * abs(np.median(a)), 1e-8)
    scaled = lambda a: (a - np.median(a)) / iqr(a)
    expected = {
        "close": scaled(close), "ATR_1": x / iqr(close), "NATR_1": x / 10, "RSI_1": (x - 50) / 50, "CMO_1": x / 100, "WILLR_1": (x + 50) / 50, "BOP_1": x, "POS_1": 2 * (x - 0.5), "ZS_1": x / 3, "RET_1": x / (1.4826 * np.median(np.abs(x))),
        "OBV": scaled(x), "volume": scaled(np.log1p(np.clip(x, 0, None))), "ITD_TRADES_LOG": x - np.median(x), "X_available": np.ones(n), "FUND_rate": np.full(n, 1000.0), "EMA_5": np.zeros(n), "unknown": scaled(x),
    }
    for name, value in expected.items():
        assert np.allclose(found[name], np.clip(value, -5, 5), atol=1e-9), name


def test_live_rows_need_a_state(spark):
    rows = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 9.0)], "part string, x double")
    done, state = normalize.stamp(rows, ["x"])
    assert state == {"x": (2.0, 1.0)} and sorted(r.x for r in done.collect()) == [-1.0, 1.0, 5.0]
    with pytest.raises(ValueError):
        normalize.live(rows, "train_zscore", None)
    assert normalize.live(rows, "none", None) is rows


def test_learned_patterns_on_planted_data(spark):
    """A planted rule: returns above 0 are followed by a rise; the tree and the attribution find it."""
    from barloom.operators import learning

    rng = np.random.default_rng(3)
    rows, c = [], 100.0
    for t in range(400):
        move = 0.05 if t % 2 else -0.04
        c *= 1 + move
        rows.append(("a", t, c, c * (1.01 + rng.random() / 50), c * 0.99, c, 5.0 + rng.random(), 1))
    frame = spark.createDataFrame(rows, "asset string, t long, open double, high double, low double, close double, volume double, trades long")
    found = learning.success_patterns(frame).where("kind = 'leaf' AND n > 20").collect()
    assert {round(r.success) for r in found} == {0, 1} and all(min(r.success, 1 - r.success) < 0.05 for r in found)
    loss = {r.feature: r.loss for r in learning.attributions(frame).collect()}
    assert max(loss, key=loss.get) == "r" and loss["r"] > 10 * abs(loss["vol"])


def test_orthogonal_momentum_matches_pandas(spark):
    frame = bars(spark, SF, "B3").toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    parts = []
    for h in (1, 3, 6):
        r = frame.groupby("asset").close.transform(lambda c: 100 * np.log(c).diff(h))
        roll = lambda f: r.groupby(frame.asset).transform(lambda x: f(x.rolling(12, min_periods=12)))  # noqa: B023, E731
        size = 1.4826 * r.abs().groupby(frame.asset).transform(lambda x: x.rolling(12, min_periods=12).median())
        z = (r / size.where(size >= 1e-8, np.maximum(roll(lambda w: w.std(ddof=0)), 1e-8)).where(size.notna())).clip(-5, 5)
        sd = z.groupby(frame.t).transform(lambda x: x.std(ddof=0))
        parts.append(z / sd.where(sd > 1e-8))
    mom = sum(parts) / 3
    natr = ((frame.high - frame.low) / frame.close).groupby(frame.asset).transform(lambda x: x.rolling(12).mean())
    expected = pd.Series(0.0, index=frame.index)
    for _, own in frame[mom.notna() & natr.notna()].groupby("t"):
        n = len(own)
        if n >= 5:
            a, b = mom[own.index].rank() / (n / 2), natr[own.index].rank() / (n / 2)
            a, b = a - a.mean(), b - b.mean()
            expected[own.index] = a - (a @ b) / (b @ b) * b if b @ b else 0.0
    found = QUERIES["XS03_orthogonal_momentum"](spark, SF).toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    assert np.allclose(found.res.astype(float), expected, atol=2e-5)
    assert np.allclose(found.mom.astype(float), mom, atol=2e-5, equal_nan=True) and mom.notna().sum() > 20


def test_threshold_pick_matches_pandas(spark):
    """Large moves reverse, small ones go on, so the pick ends inside the rows; equal moves tie."""
    rng = np.random.default_rng(5)
    rows = []
    for asset in "abcdef":
        price = 100.0
        for t in range(200):
            rows.append((asset, t, price))
            price = 100.0 if price != 100.0 and t % 3 else price * (1 + rng.choice([-0.08, -0.04, 0.02, 0.01, 0.005]))
    frame = pd.DataFrame(rows, columns=["asset", "t", "close"])
    close = frame.groupby("asset").close
    signal = frame.assign(score=frame.close / close.shift() - 1, actual=close.shift(-1) / frame.close - 1).dropna()
    signal = signal.assign(size=signal.score.abs()).sort_values(["size", "t", "asset"], ascending=[False, True, True])
    hits = (signal.score * signal.actual < 0).to_numpy().astype(float)
    places = np.arange(1, len(hits) + 1)
    picked = places[(np.cumsum(hits) / places >= 0.6) & (places >= 30)].max()
    assert 30 < picked < len(hits)
    op = next(o for o in RELATIONAL if o.name == "MET22_threshold_pick")
    found = op(spark.createDataFrame(frame)).collect()
    assert [(r["k"], r["n"]) for r in found] == [(picked, len(hits))]
