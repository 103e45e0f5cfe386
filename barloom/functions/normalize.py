"""Window normalisation by the kind of a feature, which the longest known prefix of its name decides."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds and the name prefixes of each.
PREFIXES = {
    "price_level": "open high low close hl2 HLC3 OHLC4 WCP SMA EMA WMA DEMA TEMA TRIMA HMA RMA VWMA VWAP ALMA T3_ KAMA LINREG MIDPOINT MIDPRICE BBL BBM BBU DCL DCM DCU KCL KCB KCU SUPERT PSAR ISA_ ISB_ ITS_ IKS_",
    "price_scale": "ATR TRUERANGE TR_ STDEV VAR_ MAD_ MACD MOM SLOPE DPO ABER",
    "percent": "ROC PPO NATR BBB CHOP MASSI PVR RANGE_ SUPERT_STRETCH_ ITD_RVOL",
    "osc_0_100": "RSI STOCHk STOCHd STOCHh STOCHRSIk STOCHRSId ADX DMP DMN AROOND AROONU MFI RVI UO_ CRSI PSL RVGI KST",
    "osc_sym_100": "CMO AROONOSC CFO CTI",
    "osc_willr": "WILLR",
    "unit_sym": "BOP CMF QS_ INC_ DEC_ BODY_ TIME_ SUPERT_DIR_ PSAR_DIR VOL_ASYMMETRY_ MKT_CORR_ PCT_FROM_ATH MOM_ORTH_NATR LSR_ TAKER_LSR_",
    "unit_0_1": "ER_ BBP SQZ_ON SQZ_OFF SQZ_NO UI_ WICK_ POS_ MOM_RANK_ MKT_BREADTH_ DIR_CONSISTENCY_ EFF_RATIO_ VOL_CONC_ CRASH_REBOUND_REGIME ITD_TAKER_BUY_RATIO ITD_VOL_TOPK",
    "zscore": "ZS_ SKEW KURT VOLZ_ VOL_TERM_ RISK_ADJ_MOM_ MKT_BETA_ FUND_rate_z ITD_TRADES_Z",
    "sign_robust": "CCI TSI TRIX FISHERT LOGRET PCTRET PVO PVI NVI BIAS COPC EOM SMI STC QQE RET_ VOLR_ MKT_ret_ VWAP_DEVIATION MKT_LAG_RET_ OI_chg_ LSR_GLOBAL_chg_",
    "cumulative": "OBV AD ADOSC KVO EFI PVT VP_ ENTP",
    "log_volume": "volume VOL_",
    "log_centered": "ITD_TRADES_LOG",
    "binary_flag": "FUND_available OI_available ITD_available MET_available",
    "funding_rate": "FUND_rate FUND_sum_",
}
DEFAULT_KIND = "cumulative"
FLAG_SUFFIX = "_available"
#: Kinds whose constant is information; a constant window of any other kind becomes zero.
KEPT_CONSTANT = ("binary_flag", "funding_rate")
CLIP, EPS = 5.0, 1e-8
_FINITE = 1.7976931348623157e308


def kind_of(column: str, prefixes: dict[str, str] | None = None, default: str = DEFAULT_KIND) -> str:
    """The kind of a column: the longest prefix decides. Only in the built-in table names that end in ``_available`` are flags."""
    if prefixes is None and column.endswith(FLAG_SUFFIX):
        return "binary_flag"
    table = {p: k for k, names in PREFIXES.items() for p in names.split()} if prefixes is None else prefixes
    known = max((p for p in table if column.startswith(p)), key=len, default=None)
    return default if known is None else table[known]


def kinds(columns: Sequence[str], prefixes: dict[str, str] | None = None, default: str = DEFAULT_KIND) -> dict[str, list[str]]:
    """kind -> its columns, in their order."""
    out: dict[str, list[str]] = {}
    for column in columns:
        out.setdefault(kind_of(column, prefixes, default), []).append(column)
    return out


def quantile(xs: str, n: int, q: float) -> str:
    """Linear quantile of an array of ``n`` values."""
    at = (n - 1) * q
    low, share = int(at), at - int(at)
    first = f"AT(ORDERED({xs}); {low + 1})"
    return first if share == 0 else f"({first} + {share!r} * (AT(ORDERED({xs}); {low + 2}) - {first}))"


def _median(xs: str, n: int) -> str:
    return quantile(xs, n, 0.5)


def _scaled(xs: str, n: int) -> str:
    """Less the median, by the interquartile range, a thousandth of the median's size at least."""
    width = f"greatest({quantile(xs, n, 0.75)} - {quantile(xs, n, 0.25)}, 0.001 * abs({_median(xs, n)}), {EPS!r})"
    return f"EACH({xs}; (x - {_median(xs, n)}) / {width})"


def normalised(xs: str, kind: str, n: int, center: str, scale: str) -> str:
    """An array of ``n`` finite values of a kind, normalised; prices by the centre and scale of the window of closes."""
    plain = {
        "price_level": f"(x - {center}) / {scale}", "price_scale": f"x / {scale}", "percent": "x / 10", "osc_0_100": "(x - 50) / 50", "osc_sym_100": "x / 100", "osc_willr": "(x + 50) / 50",
        "unit_sym": "x", "unit_0_1": "(x - 0.5) * 2", "zscore": "x / 3", "binary_flag": "x * 2 - 1", "funding_rate": "x * 1000",
    }
    if kind in plain:
        return f"EACH({xs}; {plain[kind]})"
    if kind == "sign_robust":
        size = f"1.4826 * {_median(f'EACH({xs}; abs(x))', n)}"
        spread = f"sqrt(greatest(TOTAL({xs}; x * x) / {n} - pow(TOTAL({xs}; x) / {n}, 2), 0))"
        return f"EACH({xs}; x / (CASE WHEN {size} < {EPS!r} THEN greatest({spread}, {EPS!r}) ELSE {size} END))"
    if kind == "log_volume":
        return _scaled(f"EACH({xs}; ln(1 + greatest(x, 0)))", n)
    if kind == "log_centered":
        return f"EACH({xs}; x - {_median(xs, n)})"
    return _scaled(xs, n)


def window_stages(columns: dict[str, str], n: int, over: str, close: str = "close") -> tuple:
    """Stages that add ``w_<name>``: the normalised windows of the last ``n`` rows of each column, an expression; rows without a full window go.

    What is not finite takes the median of the window's finite values, or 0 without any.
    """
    every = {"closes": f"LISTOF({close}) {over}"} | {f"x{i}": f"LISTOF(coalesce(CAST({e} AS DOUBLE), CAST('NaN' AS DOUBLE))) {over}" for i, e in enumerate(columns.values())}
    size = range(len(columns))
    fine = {f"f{i}": f"KEEP(x{i}; abs(x) <= {_FINITE!r})" for i in size}
    middle = {f"m{i}": f"CASE WHEN LEN(f{i}) = 0 THEN 0e0 ELSE (AT(ORDERED(f{i}); CAST(floor((LEN(f{i}) + 1) / 2e0) AS INT)) + AT(ORDERED(f{i}); CAST(floor(LEN(f{i}) / 2e0) AS INT) + 1)) / 2e0 END" for i in size}
    filled = {f"v{i}": f"EACH(x{i}; CASE WHEN abs(x) <= {_FINITE!r} THEN x ELSE m{i} END)" for i in size}
    scale = {"center": _median("closes", n), "scale": f"greatest({quantile('closes', n, 0.75)} - {quantile('closes', n, 0.25)}, 0.001 * abs({_median('closes', n)}), {EPS!r})"}
    out = {}
    for i, name in enumerate(columns):
        kind = kind_of(name)
        done = f"EACH({normalised(f'v{i}', kind, n, 'center', 'scale')}; greatest(least(x, {CLIP!r}), -{CLIP!r}))"
        out[f"w_{name}"] = done if kind in KEPT_CONSTANT else f"CASE WHEN LOWEST(v{i}) = HIGHEST(v{i}) THEN EACH(v{i}; 0e0) ELSE {done} END"
    return every, f"SELECT * FROM $in WHERE LEN(closes) = {n}", fine, middle, filled, scale, out


@dataclass
class Normaliser:
    """A named way to scale columns: ``fit`` makes a state from training rows alone, ``apply`` uses it on any rows."""

    name: str
    fit: Callable[[DataFrame, Sequence[str]], dict]
    apply: Callable[[DataFrame, dict], DataFrame]
    #: whether live rows need a fitted state
    stateful: bool = True


@dataclass
class Registry:
    """Named plug-ins; a name is taken once and an entry has the attributes of its contract."""

    contract: tuple[str, ...] = ()
    entries: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, entry: object) -> object:
        if name in self.entries:
            raise ValueError(f"{name!r} exists")
        if missing := [a for a in self.contract if not hasattr(entry, a)]:
            raise TypeError(f"{name!r} lacks {', '.join(missing)}")
        self.entries[name] = entry
        return entry

    def get(self, name: str) -> object:
        if name not in self.entries:
            raise KeyError(f"no {name!r}; known: {', '.join(sorted(self.entries))}")
        return self.entries[name]


NORMALISERS = Registry(("name", "fit", "apply", "stateful"))


def _moments(train: DataFrame, columns: Sequence[str]) -> dict:
    found = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    return {c: (found[f"mean_{c}"], found[f"sd_{c}"]) for c in columns}


def _standardised(rows: DataFrame, state: dict) -> DataFrame:
    return rows.withColumns({c: F.greatest(F.least((F.col(c) - m) / s, F.lit(CLIP)), F.lit(-CLIP)) if s else F.lit(0.0) for c, (m, s) in state.items()})


NORMALISERS.add("train_zscore", Normaliser("train_zscore", _moments, _standardised))
NORMALISERS.add("none", Normaliser("none", lambda train, columns: {}, lambda rows, state: rows, stateful=False))


def stamp(splits: DataFrame, columns: Sequence[str], name: str = "train_zscore", part: str = "part") -> tuple[DataFrame, dict]:
    """All splits by a state that is fitted on the rows of 'train' alone, and that state."""
    way = NORMALISERS.get(name)
    state = way.fit(splits.where(F.col(part) == "train"), columns)
    return way.apply(splits, state), state


def live(rows: DataFrame, name: str, state: dict | None) -> DataFrame:
    """Live rows by a fitted state; a way that needs one refuses to go without."""
    way = NORMALISERS.get(name)
    if way.stateful and not state:
        raise ValueError(f"{name!r} needs the state that was fitted on training rows")
    return way.apply(rows, state or {})
