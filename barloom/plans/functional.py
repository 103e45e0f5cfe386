"""Queries of operators that are functions over frames: readers, sinks, registries, user functions and learned studies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import apply_filter, drop_matching, select_available
from ..operators import learning, pairs
from ..sources.bars import bars, bars_sql
from ..sources.readers import read_unsealed, upsert
from ..sources.sinks import append_ledger

FUNCTIONAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_A, _B3 = f"({bars_sql('A')}) b", f"({bars_sql('B3')}) b"
_HALF = f"(SELECT (min(t) + max(t)) // 2 FROM {_A})"


def _fitted(rows: DataFrame) -> int:
    """The step up to which the learned studies fit: two thirds of the span."""
    span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return span.lo + 2 * (span.hi - span.lo) // 3


def _query(name: str, oracle: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        FUNCTIONAL[name] = (function, oracle)
        return function

    return add


@_query("SRC16_upsert", f"SELECT asset, t, CASE WHEN t >= 19740 THEN trades + 1 ELSE trades END AS trades FROM {_A}")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "A").select("asset", "t", "trades")
    return upsert(rows.where("t < 19745"), rows.where("t >= 19740").withColumn("trades", F.expr("trades + 1")))


@_query("SRC31_guarded_read", f"SELECT asset, t, trades FROM {_A}")
def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_unsealed(bars(spark, sf_dir, "A"), ["sealed-usdt"], 10**6).select("asset", "t", "trades")


@_query("SNK09_ledger", f"SELECT t, CAST(count(*) AS DOUBLE) AS pnl FROM {_A} GROUP BY t")
def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir, "A").groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("pnl"))
    return append_ledger(days.where("t < 19740").withColumn("pnl", F.expr("CASE WHEN t % 3 > 0 THEN pnl END")), days)


@_query("FIL04_drop_columns", f"SELECT asset, t, open, close FROM {_A}")
def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_matching(bars(spark, sf_dir, "A"), ["high", "lo*", "vol*", "trade?"])


@_query("FIL05_select_available", f"SELECT asset, t, trades FROM {_A}")
def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_available(bars(spark, sf_dir, "A"), ["asset", "t", "funding", "trades"])


@_query("FIL09_registered_filter", f"SELECT asset, t, trades FROM {_A} WHERE 100 * (high - low) / close > 1")
def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filter(bars(spark, sf_dir, "A"), "relative_range", least=1.0).select("asset", "t", "trades")


@_query("SCL06_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long")["k"].alias("k")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(parsed).agg(F.count(F.lit(1)).alias("n"))


@_query("SCL07_tag_sets", "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS tags, list_has_any(string_split(upper(p_type), ' '), ['STEEL', 'BRASS', 'SMALL']) AS touched FROM part")
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", F.size(F.split("p_type", " ")).cast("long").alias("tags"), F.arrays_overlap(F.split(F.upper("p_type"), " "), F.array(*map(F.lit, ("STEEL", "BRASS", "SMALL")))).alias("touched"))


@_query("MDL04_batched_prediction", f"SELECT asset, t, floor((close - open) * 1000 + 0.5) / 1000 AS score FROM {_A}")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "A").select("asset", "t", "open", "close")
    return learning.score_batches(rows, lambda f: ((f["close"] - f["open"]) * 1000 + 0.5).floordiv(1) / 1000).select("asset", "t", "score")


@_query("UDF03_grouped_map", f"SELECT asset, max(trades) - min(trades) AS span FROM {_A} GROUP BY asset")
def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": rows["asset"].iloc[:1], "span": [int(rows["trades"].max() - rows["trades"].min())]})

    return learning.by_group(bars(spark, sf_dir, "A").select("asset", "trades"), ["asset"], span, "asset string, span long")


@_query("UDF05_user_predictor", f"SELECT asset, t, (SELECT max(x.trades) FROM {_A.replace(') b', ') x')} WHERE x.asset = b.asset AND x.t <= {_HALF}) AS pred FROM {_A} WHERE t > {_HALF}")
def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def predict(train: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        return rest[["asset", "t"]].assign(pred=pd.array([train["trades"].max() if len(train) else None] * len(rest), dtype="Int64"))

    rows = bars(spark, sf_dir, "A").select("asset", "t", "trades")
    span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    rows = rows.withColumn("part", F.when(F.col("t") <= (span.lo + span.hi) // 2, "train").otherwise("test"))
    return learning.predict_splits(rows, ["asset"], predict, "asset string, t long, pred long")


@_query("ML05_regimes")
def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.regimes(bars(spark, sf_dir, "B3"))


@_query("ML06_importances")
def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.importances(bars(spark, sf_dir, "B3"))


@_query("ML08_validated_leaves")
def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B3")
    return learning.leaves(rows, _fitted(rows))


@_query("ML10_boosted_deciles")
def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B3")
    return learning.boosted_deciles(rows, _fitted(rows))


@_query("MET18_platt")
def _platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B3")
    return learning.calibrated(rows, _fitted(rows))


_PAIRS = f"""WITH p AS (SELECT asset, t, ln(close) - lag(ln(close)) OVER (PARTITION BY asset ORDER BY t) AS r FROM {_A})
    SELECT a.asset AS a, b.asset AS b, count(*) AS n, floor(corr(a.r, b.r) * 1000000 + 0.5) / 1000000 AS rho
    FROM p a JOIN p b ON a.t = b.t AND a.asset < b.asset WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.asset, b.asset HAVING count(*) >= 10"""


@_query("AGG11_pair_correlation", _PAIRS)
def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_correlations(bars(spark, sf_dir, "A"), digits=6)


#: The test span is the last eighth of the steps, the train span the first half, so an embargo lies between.
TRAIN, TEST = 0.5, 0.875
_WINDOWS = f"""WITH w AS (SELECT asset, t, close AS x0, lag(close, 1) OVER o AS x1, lag(close, 2) OVER o AS x2, lag(close, 3) OVER o AS x3 FROM {_A} WINDOW o AS (PARTITION BY asset ORDER BY t)),
    m AS (SELECT *, list_avg([x0, x1, x2, x3]) AS m, list_stddev_pop([x0, x1, x2, x3]) AS sd FROM w WHERE x3 IS NOT NULL),
    z AS (SELECT asset, t, (x0 - m) / sd AS z0, (x1 - m) / sd AS z1, (x2 - m) / sd AS z2, (x3 - m) / sd AS z3 FROM m WHERE sd > 0),
    g AS (SELECT min(t) + CAST(floor({TRAIN} * (max(t) - min(t))) AS BIGINT) AS train_end, min(t) + CAST(floor({TEST} * (max(t) - min(t))) AS BIGINT) AS test_from FROM {_A}),
    d AS (SELECT q.asset, q.t, l.asset AS near_asset, l.t AS near_t, sqrt((q.z0 - l.z0) ** 2 + (q.z1 - l.z1) ** 2 + (q.z2 - l.z2) ** 2 + (q.z3 - l.z3) ** 2) AS dist FROM z q, z l, g WHERE q.t > g.test_from AND l.t <= g.train_end)
    SELECT asset, t, k, floor(dist * 1000000 + 0.5) / 1000000 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY asset, t ORDER BY dist, near_asset, near_t) AS k FROM d) r WHERE k <= 3"""


@_query("JOIN15_nearest_windows", _WINDOWS)
def _all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of equal distance may stand in either order, so the distances are compared."""
    rows = bars(spark, sf_dir, "A")
    span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    train, test = (span.lo + int(share * (span.hi - span.lo)) for share in (TRAIN, TEST))
    found = pairs.all_nearest_windows(rows, f"t <= {train}", f"t > {test}")
    return found.select("asset", "t", F.col("k").cast("long").alias("k"), (F.floor(F.col("dist") * 1000000 + 0.5) / 1000000).alias("dist"))
