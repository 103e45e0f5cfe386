"""Queries of plug-ins, target resolution, governance and user functions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, registry
from ..operators import governance, learning
from ..operators.core import rounded
from ..operators.relational import _BOUNDS, _SIGNAL, _op
from ..sources import sinks
from ..sources.bars import bars, bars_sql
from .functional import _query

_A, _B3 = f"({bars_sql('A')}) b", f"({bars_sql('B3')}) b"
_MOVE = f"SELECT asset, t, close / lag(close) OVER (PARTITION BY asset ORDER BY t) - 1 AS score, lead(close) OVER (PARTITION BY asset ORDER BY t) / close - 1 AS actual FROM {_A}"
_SPAN = f"(SELECT min(t) AS lo, max(t) AS hi FROM ({_MOVE}) m WHERE score IS NOT NULL AND actual IS NOT NULL) g"


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query("SMP12_feature_kinds", "SELECT * FROM (VALUES ('EMA_20', 'price_level'), ('NATR_14', 'percent'), ('STOCHRSIk_14', 'osc_0_100'), ('EFF_RATIO_available', 'binary_flag'), ('FUND_rate', 'funding_rate'), ('FUND_rate_z', 'zscore'), ('BBP_5', 'unit_0_1'), ('nameless', 'cumulative'), ('MOM_RANK_5', 'unit_0_1'), ('MOM_10', 'price_scale')) v(feature, kind)")
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["EMA_20", "NATR_14", "STOCHRSIk_14", "EFF_RATIO_available", "FUND_rate", "FUND_rate_z", "BBP_5", "nameless", "MOM_RANK_5", "MOM_10"]
    return _values(spark, [(n, normalize.kind_of(n)) for n in names], "feature string, kind string")


@_query("AGG28_kind_groups", "SELECT * FROM (VALUES ('price_level', 2, 'EMA_20,close'), ('percent', 1, 'NATR_14'), ('cumulative', 1, 'nameless')) v(kind, n, features)")
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.kinds(["EMA_20", "close", "NATR_14", "nameless"])
    return _values(spark, [(k, len(v), ",".join(v)) for k, v in found.items()], "kind string, n int, features string")


@_query("SMP17_split_stamping", f"SELECT part, count(*) AS n, {rounded('avg(z)')} AS mean, {rounded('max(abs(z))')} AS widest FROM (SELECT p.part, greatest(least((p.score - f.m) / f.s, 5), -5) AS z FROM (SELECT score, CASE WHEN t <= lo + CAST(floor(0.65e0 * (hi - lo)) AS BIGINT) THEN 'train' ELSE 'rest' END AS part FROM ({_MOVE}) m, {_SPAN} WHERE score IS NOT NULL AND actual IS NOT NULL) p, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM ({_MOVE}) m, {_SPAN} WHERE score IS NOT NULL AND actual IS NOT NULL AND t <= lo + CAST(floor(0.65e0 * (hi - lo)) AS BIGINT)) f) q GROUP BY part")
def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _op("split", (*_SIGNAL, _BOUNDS, {"part": "CASE WHEN t <= train_end THEN 'train' ELSE 'rest' END"}), "asset", "t", "score", "part")
    rows, _ = normalize.stamp(split(bars(spark, sf_dir, "A")), ["score"])
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.expr(rounded("avg(score)")).alias("mean"), F.expr(rounded("max(abs(score))")).alias("widest"))


@_query("MET01_target_resolution", "SELECT * FROM (VALUES ('None', 'high,low,close'), ('close', 'close'), ('low high', 'low,high'), ('all', 'close,range'), ('mixed', 'high,trend')) v(asked, names)")
def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("None", None, None), ("close", "close", None), ("low high", "low high", None), ("all", "all", ["close", "range"]), ("mixed", ["high", {"name": "trend", "kind": "categorical", "classes": ("down", "up")}, "high"], None)]
    return _values(spark, [(n, ",".join(t.name for t in governance.resolve_targets(a, available))) for n, a, available in asked], "asked string, names string")


@_query("SPL01_embargo_length", "SELECT spans, ratio, horizon, greatest(spans, ratio - 1) + horizon AS bars FROM (VALUES (30, 24, 3), (10, 24, 3), (0, 4, 1)) v(spans, ratio, horizon)")
def _embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(s, r, h, registry.embargo([s], r, h)) for s, r, h in ((30, 24, 3), (10, 24, 3), (0, 4, 1))], "spans int, ratio int, horizon int, bars int")


@_query("RES14_live_history", "SELECT warm_up, ratio, horizon, warm_up * ratio + horizon AS bars FROM (VALUES (55, 4, 3), (20, 1, 1)) v(warm_up, ratio, horizon)")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(w, r, h, registry.required_bars([w, w // 2], h, r)) for w, r, h in ((55, 4, 3), (20, 1, 1))], "warm_up int, ratio int, horizon int, bars int")


@_query("SRT07_work_split", "SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 2), ('e', 1), ('f', 0)) v(item, worker)")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest first: 9, 7, 6, 5, 4, 2 over three workers make 11, 11 and 11."""
    return _values(spark, sorted(governance.split_work({"a": 9, "b": 7, "c": 6, "d": 5, "e": 4, "f": 2}, 3).items()), "item string, worker int")


@_query("SRT08_ordered_map", f"SELECT row_number() OVER (ORDER BY asset, t) AS i, asset, t, trades * 2 AS twice FROM {_B3}")
def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B3").select("asset", "t", "trades")
    twice = lambda f: f[["asset", "t"]].assign(twice=f["trades"] * 2)
    return learning.ordered_map(rows, twice, "asset string, t long, twice long", ["asset", "t"])


_RANKED = f"SELECT asset, row_number() OVER (ORDER BY sha256('seed:' || asset), asset) - 1 AS i, count(*) OVER () AS n, max(trades) > 2 AS derived FROM {_A} GROUP BY asset HAVING count(*) >= 5"


@_query("SPL13_sealed_buckets", f"SELECT count(*) AS sealed, count(CASE WHEN derived AND i % 6 = 2 THEN 1 END) AS refused FROM ({_RANKED}) r WHERE i < ceil(0.4 * n)")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many are sealed, and how many of them the third bucket refused and another took."""
    eligible = bars(spark, sf_dir, "A").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), (F.max("trades") > 2).alias("derived")).where("n >= 5")
    rows = governance.sealed_buckets(eligible, "seed")
    return rows.agg(F.count(F.lit(1)).alias("sealed"), F.count_if("moved").alias("refused"))


@_query("GOV01_open_once", "SELECT * FROM (VALUES (1, 'H1', 'opened'), (2, 'H1', 'already opened'), (3, 'H2', 'opened'), (4, 'H9', 'unknown bucket'), (5, 'H3', 'not confirmed')) v(attempt, bucket, result)")
def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = f"{sinks.work_folder(spark)}/access.json"
    card = {"confirmation": "true", "frozen_rules_sha256": hashlib.sha256(b"rules").hexdigest()}
    asked = [("H1", card), ("H1", card), ("H2", card), ("H9", card), ("H3", card | {"confirmation": "false"})]
    return _values(spark, [(k + 1, b, governance.try_open(spark, log, {"H1": ["a"], "H2": ["b"], "H3": ["c"]}, b, c)) for k, (b, c) in enumerate(asked)], "attempt int, bucket string, result string")


@_query("GOV02_touched_ledger", f"SELECT asset, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (SELECT asset, 'busy' AS rule FROM {_A} WHERE trades > 3 UNION ALL SELECT asset, 'early' FROM {_A} WHERE t < (SELECT min(t) + 3 FROM {_A})) q GROUP BY asset")
def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "A")
    return governance.touched(rows, {"busy": F.col("trades") > 3, "early": F.col("t") < rows.agg(F.min("t")).first()[0] + 3})


@_query("GOV03_run_contract", "SELECT * FROM (VALUES ('a.json', 'ok'), ('b.json', 'changed'), ('c.json', 'missing')) v(output, state)")
def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sinks.work_folder(spark)
    for name in "ab":
        sinks.write_json(spark, f"{root}/{name}.json", {"v": name})
    digest = hashlib.sha256(json.dumps({"v": "a"}, sort_keys=True).encode()).hexdigest()
    return governance.validate_outputs(spark, root, {"a.json": digest, "b.json": digest, "c.json": digest})


@_query("GOV04_run_profile", f"SELECT * FROM (SELECT 'count' AS step, count(*) AS rows FROM {_A} UNION ALL SELECT 'assets', count(DISTINCT asset) FROM {_A}) q")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "A")
    run = governance.profile(spark, {"count": lambda: rows.count(), "assets": lambda: rows.select("asset").distinct().count()})
    return run.where("seconds >= 0 AND memory_mb > 0").select("step", "rows")


@_query("UDF01_predicate_registry", f"SELECT asset, count(*) AS n FROM {_A} WHERE close > open GROUP BY asset")
def _predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = normalize.Registry()
    filters.add("rising", lambda: F.col("close") > F.col("open"))
    return bars(spark, sf_dir, "A").where(filters.get("rising")()).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@_query("UDF02_rolling_udaf", f"SELECT asset, t, {rounded('max(close) OVER w - min(close) OVER w')} AS spread FROM {_A} WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda v: float(v.max() - v.min())
    return learning.rolling_apply(bars(spark, sf_dir, "A"), "close", 5, spread, "spread").select("asset", "t", F.expr(rounded("spread")).alias("spread"))


@_query("UDF06_model_scorer", f"SELECT asset, t, {rounded('0.5 * (close - open) + 0.1 * volume')} AS score FROM {_B3}")
def _scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B3").select("asset", "t", "open", "close", "volume")
    return learning.score_batches(rows, lambda f: 0.5 * (f["close"] - f["open"]) + 0.1 * f["volume"]).select("asset", "t", F.expr(rounded("score")).alias("score"))


@_query("UDF07_plugin_registries", "SELECT * FROM (VALUES ('none', false), ('train_zscore', true)) v(name, stateful)")
def _plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(n, e.stateful) for n, e in sorted(normalize.NORMALISERS.entries.items())], "name string, stateful boolean")


@_query("SCL09_registered_objects", "SELECT * FROM (VALUES ('twice', 'exists'), ('bad', 'lacks fit'), ('ok', 'added')) v(name, result)")
def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, made = [], normalize.Registry(("fit",))
    made.add("twice", normalize.NORMALISERS.get("none"))
    for name, entry in (("twice", normalize.NORMALISERS.get("none")), ("bad", object()), ("ok", normalize.NORMALISERS.get("none"))):
        try:
            made.add(name, entry)
            found.append((name, "added"))
        except (ValueError, TypeError) as error:
            found.append((name, str(error).split("' ", 1)[1]))
    return _values(spark, found, "name string, result string")


@_query("ML07_success_patterns")
def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.success_patterns(bars(spark, sf_dir, "B3"))


@_query("MDL06_permutation_attributions")
def _attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.attributions(bars(spark, sf_dir, "B3"))
