"""Live operators: closed bars, sessions, incremental archives and per-asset state over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import present
from ..sources.sinks import append_ledger

_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, folder: str, schema: str = _EVENT, files: int | None = None) -> DataFrame:
    """Rows of parquet files as they arrive in a folder, ``files`` a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def closed_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars that come out once the watermark has closed their window; later rows are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("asset"))
    bars = grouped.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return bars.select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of each user, ended by a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """First arrival of each key; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _folded(events: DataFrame, step: Callable, start: tuple, schema: str, state: str, late: str, idle: str) -> DataFrame:
    """Fold each asset's values in order of (ts, event_id), its state carried from batch to batch.

    A batch's rows are brought into order before they are folded, however they were cut into
    frames; rows older than the last one folded are late: they are counted and left out. An
    asset that is silent for ``idle`` of event time after the watermark gives up its state.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        *held, last, dropped = group.get if group.exists else (*start, -(2**62), 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at = rows["ts"].astype("int64").to_numpy() // (1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1)
        fresh = at >= last
        dropped += int((~fresh).sum())
        for x in rows["value"].to_numpy()[fresh]:
            held = step(held, float(x))
        last = int(at[fresh].max()) if fresh.any() else last
        group.update((*held, last, dropped))
        group.setTimeoutTimestamp(max(last // 1000, group.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame([(key[0], *_shown(held), dropped)], columns=[c.split()[0] for c in schema.split(", ")])

    rows = events.withWatermark("ts", late).select(F.col("event_type").alias("asset"), "event_id", "ts", "value")
    return rows.groupBy("asset").applyInPandasWithState(fold, schema, f"{state}, last long, dropped long", "update", GroupStateTimeout.EventTimeTimeout)


def _shown(held: list) -> list:
    return [float(np.mean(h)) if isinstance(h, list) else h for h in held]


def running_ema(events: DataFrame, span: int = 20, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """(asset, ema, n, dropped): exponential mean of each asset's values, seeded with the first, and how many rows it holds."""
    alpha = 2 / (span + 1)

    def step(held: tuple, x: float) -> tuple:
        value, n = held
        return (x if not n else value + alpha * (x - value), n + 1)

    return _folded(events, step, (0.0, 0), "asset string, ema double, n long, dropped long", "ema double, n long", late, idle)


def rolling_mean(events: DataFrame, rows: int = 20, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """(asset, mean, n, dropped): mean of each asset's last values; the state holds no more than these."""

    def step(held: tuple, x: float) -> tuple:
        values, n = held
        return ([*values[-(rows - 1) :], x] if rows > 1 else [x], n + 1)

    return _folded(events, step, ([], 0), "asset string, mean double, n long, dropped long", "tail array<double>, n long", late, idle)


def ledger_sink(path: str, key: str = "t", value: str = "pnl") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append a batch of decisions to the ledger of a folder; a settled row that changes stops the stream.

    Each batch writes a version of its own, so one that is repeated after a failure starts from the version before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], f"{key} long, {value} double")
        append_ledger(old, batch.groupBy(key).agg(F.max(value).alias(value)), key, value).write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def recalibrated(path: str, share: float = 0.8) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is judged by the quantile of all batches before it, then joins them."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            cut = spark.read.parquet(f"{path}/seen").where(F.col("batch") < number).agg(F.percentile("value", share).alias("q"))
            judged = batch.crossJoin(F.broadcast(cut)).agg(F.lit(number).alias("batch"), F.count(F.lit(1)).alias("n"), F.max("q").alias("q"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("covered"))
            judged.write.mode("overwrite").parquet(f"{path}/judged/number={number}")
        batch.select("value", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/seen/number={number}")

    return write


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is available, batch by batch."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is available and return it, from a folder beside the checkpoint: of any size, as no row passes through the driver.

    Each batch writes a folder of its own, so one that is repeated after a failure replaces what it wrote.
    """
    out = f"{checkpoint}-out"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not present(spark, {"": out})[""]:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
