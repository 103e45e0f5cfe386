"""Operators over all assets at one step, and statistics of them."""

from __future__ import annotations

from .core import ACROSS, LAG, Operator, full, lag, prior


def tie_rank(x: str, keys: str = "t") -> str:
    """Average rank of ties within a group."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2e0)"


def spearman(x: str, y: str, keys: str, source: str = "$in", least: int = 5, extra: str = "") -> str:
    """Rank correlation of known pairs in each group of at least ``least`` rows."""
    ranked = f"SELECT *, {tie_rank(x, keys)} AS rx, {tie_rank(y, keys)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    return f"SELECT {keys}, count(*) AS n, corr(rx, ry) AS ic{extra} FROM ({ranked}) q GROUP BY {keys} HAVING count(*) >= {least}"


def _op(name: str, stages: tuple, *out: str, mapping: str = "B3") -> Operator:
    return Operator(name, stages, out, mapping)


_R = {"r": f"ln(close) - {lag('ln(close)')}"}
_FWD = {"fwd": f"lead(close) {LAG} / close - 1"}
_VOL = {"pvol": f"CASE WHEN count(r) {prior(12)} >= 5 THEN stddev_samp(r) {prior(12)} END"}
_KNOWN = "SELECT * FROM $in WHERE r IS NOT NULL"
_BOTH = "SELECT * FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL"
_TRIPLE = "SELECT * FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL AND pvol IS NOT NULL"
_DECILE = {"rn": "row_number() OVER (PARTITION BY t ORDER BY r, asset)", "n": f"count(*) {ACROSS}"}
_BIN = {"bin": "CASE WHEN n > 1 THEN greatest(CAST(ceil((rn - 1) * 5e0 / (n - 1)) AS BIGINT), 1) - 1 ELSE 0 END"}

CROSS_SECTION = [
    _op("XS01_momentum_rank", (_R, _KNOWN, {"rank": f"{tie_rank('r')} / count(*) {ACROSS}"}), "asset", "t", "~rank"),
    _op("XS02_market_breadth", ({"r": f"ln(close) - {lag('ln(close)', 3)}"}, "SELECT t, count(r) AS n, coalesce(avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END), 0.5) AS breadth FROM $in GROUP BY t"), "t", "n", "~breadth"),
    _op("XS04_target_zscore_rank", (_R, _KNOWN, {"m": f"avg(r) {ACROSS}", "s": f"stddev_pop(r) {ACROSS}", "n": f"count(*) {ACROSS}", "rn": "row_number() OVER (PARTITION BY t ORDER BY r, asset)"}, {"z": "CASE WHEN n < 5 THEN r WHEN s < 0.000000001 THEN 0 ELSE greatest(least((r - m) / s, 5), -5) END", "rk": "CASE WHEN n < 5 THEN r ELSE (rn - 1) * 2e0 / (n - 1) - 1 END"}), "asset", "t", "~z", "~rk"),
    _op("XS05_inverse_zscore", (_R, _KNOWN, "SELECT a.asset, a.t, a.r, g.m, g.s FROM $in a LEFT JOIN (SELECT t, avg(r) AS m, stddev_pop(r) AS s FROM $in GROUP BY t HAVING count(*) >= 5) g ON a.t = g.t", {"z": "CASE WHEN s IS NULL THEN r ELSE (r - m) / nullif(s, 0) END"}, {"back": "CASE WHEN s IS NULL THEN z ELSE z * s + m END"}), "asset", "t", "~back"),
    _op("XS06_median_relative", (_R, _KNOWN, "SELECT a.*, g.med FROM $in a JOIN (SELECT t, PCTL(r, 0.5) AS med FROM $in GROUP BY t) g ON a.t = g.t", {"rel": "r - med", "cls": "CASE WHEN r > med THEN 1 ELSE 0 END"}), "asset", "t", "~rel", "cls"),
    _op("XS07_group_size_filter", ({"n": f"count(*) {ACROSS}"}, "SELECT * FROM $in WHERE n >= 100"), "asset", "t", "n"),
    _op("XS08_demean_universe", (_R, {"inside": "volume >= 100"}, {"x": f"r - avg(CASE WHEN inside THEN r END) {ACROSS}"}), "asset", "t", "~x"),
    _op("XS09_rank_ic", (_R, _FWD, spearman("r", "fwd", "t")), "t", "n", "~ic"),
    _op("XS10_quintile_ic", (_R, _FWD | _VOL, _TRIPLE, {"n": f"count(*) {ACROSS}", "rn": "row_number() OVER (PARTITION BY t ORDER BY pvol, asset)"}, _BIN, spearman("r", "fwd", "t, bin"), "SELECT t, count(*) AS bins, avg(ic) AS ic FROM $in GROUP BY t"), "t", "bins", "~ic"),
    _op("XS11_partial_rank_ic", (_R, _FWD | _VOL, _TRIPLE, {"a": tie_rank("r"), "b": tie_rank("fwd"), "c": tie_rank("pvol")}, "SELECT t, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM $in GROUP BY t HAVING count(*) >= 10", {"ic": "(ab - ac * bc) / nullif(sqrt((1 - ac * ac) * (1 - bc * bc)), 0)"}), "t", "n", "~ic"),
    _op("XS12_group_ic", (_R, _FWD, spearman("r", "fwd", "t", least=10), "SELECT count(*) AS groups, avg(ic) AS mean_ic FROM $in"), "groups", "~mean_ic"),
    _op("XS13_pearson_by_step", (_R, _FWD, _BOTH, "SELECT t, count(*) AS n, corr(r, fwd) AS pearson FROM $in GROUP BY t HAVING count(*) >= 5"), "t", "n", "~pearson"),
    _op("XS14_rank_target", (_R, _KNOWN, {"target": f"{tie_rank('r')} / count(*) {ACROSS} - 0.5 / count(*) {ACROSS} - 0.5"}), "asset", "t", "~target"),
    _op("XS15_decile", (_R, _KNOWN, _DECILE, _BIN), "asset", "t", "bin"),
    _op("XS16_peer_mean", (_R, _KNOWN, {"peer": f"(sum(r) {ACROSS} - r) / nullif(count(r) {ACROSS} - 1, 0)"}), "asset", "t", "~peer"),
    _op("XS17_mixed_steps", ({"g": "CAST(floor(t / 3e0) AS BIGINT)"}, "SELECT g, count(DISTINCT t) AS steps, count(*) AS n FROM $in GROUP BY g HAVING count(DISTINCT t) > 1"), "g", "steps", "n"),
    _op("XS18_fama_macbeth", (_R, _FWD | _VOL, _TRIPLE, {"a": f"{tie_rank('r')} / count(*) {ACROSS}", "b": f"{tie_rank('pvol')} / count(*) {ACROSS}"}, "SELECT t, count(*) AS n, covar_pop(a, fwd) AS ay, covar_pop(b, fwd) AS byy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM $in GROUP BY t HAVING count(*) >= 10", {"ba": "(ay * bb - byy * ab) / nullif(aa * bb - ab * ab, 0)", "bv": "(byy * aa - ay * ab) / nullif(aa * bb - ab * ab, 0)"}, "SELECT count(*) AS steps, avg(ba) AS mean_a, avg(ba) / (stddev_samp(ba) / sqrt(count(ba))) AS t_a, avg(bv) AS mean_b, avg(bv) / (stddev_samp(bv) / sqrt(count(bv))) AS t_b FROM $in"), "steps", "~mean_a", "~t_a", "~mean_b", "~t_b"),
    _op("XS19_quintile_long_short", (_R, _FWD, _BOTH, _DECILE, _BIN, "SELECT t, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) - 0.002 AS net FROM $in WHERE t % 2 = 0 GROUP BY t"), "t", "~net"),
    _op("STD02_ic_by_year", (_R, _FWD, spearman("r", "fwd", "t"), "SELECT CAST(floor(t / 12e0) AS BIGINT) + 1970 AS year, count(*) AS steps, avg(ic) AS mean_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS tstat FROM $in GROUP BY 1"), "year", "steps", "~mean_ic", "~tstat"),
    _op("REC16_turnover", (_R, _KNOWN, {"w": f"(r - avg(r) {ACROSS}) / nullif(sum(abs(r)) {ACROSS}, 0)"}, "SELECT a.t, sum(abs(a.w - coalesce(b.w, 0))) AS enter FROM $in a LEFT JOIN $in b ON a.asset = b.asset AND b.t = a.t - 1 GROUP BY a.t"), "t", "~enter"),
    _op("REC17_leg_turnover", (_R, _KNOWN, _DECILE, _BIN, "SELECT * FROM $in WHERE bin = 4", "SELECT a.t, count(*) AS n, 1 - count(b.asset) / CAST(count(*) AS DOUBLE) AS turnover FROM $in a LEFT JOIN $in b ON a.asset = b.asset AND b.t = a.t - 1 GROUP BY a.t"), "t", "n", "~turnover"),
    _op("REC18_rotation", ({"mom": f"close / {lag('close', 6)} - 1"} | _FWD, "SELECT * FROM $in WHERE t % 3 = 0 AND mom > 0", {"k": "row_number() OVER (PARTITION BY t ORDER BY mom DESC, asset)"}, "SELECT t, count(*) AS held, avg(fwd) AS ret FROM $in WHERE k <= 5 GROUP BY t"), "t", "held", "~ret"),
    _op("SIM13_market_neutral", (_R, _FWD, _BOTH, _DECILE, _BIN, "SELECT t, avg(CASE WHEN bin = 4 THEN fwd END) AS top, avg(CASE WHEN bin = 0 THEN fwd END) AS bottom, count(*) AS n FROM $in GROUP BY t HAVING count(*) >= 10", {"long_short": "(top - bottom) / 2 - 0.0014", "long_only": "top - 0.0014", "short_only": "-bottom - 0.0014"}), "t", "~long_short", "~long_only", "~short_only"),
    _op("SIM14_rank_weighted", (_R, _FWD, _BOTH, {"c": f"{tie_rank('r')} - (count(*) {ACROSS} + 1) / 2e0"}, {"w": f"c / nullif(sum(abs(c)) {ACROSS}, 0)"}, "SELECT t, sum(w * fwd) AS ret, sum(abs(w)) AS gross FROM $in GROUP BY t"), "t", "~ret", "~gross"),
    _op("SIM15_decile_table", (_R, _FWD, _BOTH, _DECILE, _BIN, {"rel": f"fwd - avg(fwd) {ACROSS}"}, "SELECT bin, count(*) AS n, avg(rel) AS rel FROM $in GROUP BY bin"), "bin", "n", "~rel"),
    _op("SIM16_grid_report", (_R, _FWD, _BOTH, _DECILE, "SELECT s.*, q.q FROM $in s CROSS JOIN (SELECT 5 AS q UNION ALL SELECT 10) q", {"bin": "CAST(floor((rn - 1) * q / CAST(n AS DOUBLE)) AS BIGINT)"}, "SELECT q, t, avg(CASE WHEN bin = q - 1 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS ls FROM $in GROUP BY q, t", "SELECT q, CASE WHEN t % 4 = 3 THEN 'test' ELSE 'val' END AS part, count(ls) AS n, avg(ls) AS mean, stddev_pop(ls) AS sd FROM $in GROUP BY 1, 2"), "q", "part", "n", "~mean", "~sd"),
    _op("SIM19_weights_backtest", (_R, _FWD, _BOTH, {"w": f"(r - avg(r) {ACROSS}) / nullif(sum(abs(r)) {ACROSS}, 0)"}, {"pw": lag("w")}, "SELECT t, sum(w * fwd) AS gross, sum(abs(w - coalesce(pw, 0))) * 0.0007 AS cost, sum(w * fwd) - sum(abs(w - coalesce(pw, 0))) * 0.0007 AS net FROM $in GROUP BY t"), "t", "~gross", "~cost", "~net"),
]
