"""File scans: extended klines, archives, registries and manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KLINE_COLUMNS = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume")


def epoch_to_timestamp(value: Column) -> Column:
    """Epoch numbers by magnitude (s, ms, us or ns) or ISO strings; anything else is null."""
    number = value.try_cast("double")
    size = F.abs(number)
    micros = F.when(size >= 1e17, number / 1000).when(size >= 1e14, number).when(size >= 1e11, number * 1000).otherwise(number * 1e6)
    return F.coalesce(F.timestamp_micros(micros.cast("long")), F.try_to_timestamp(value.cast("string")))


def read_series(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], asset_pattern: str = r"([^/]+?)(?:\.csv)?(?:\.gz)?$") -> DataFrame:
    """(asset, ts, columns) of every CSV (plain or gzip) under ``path``, each read by its own header.

    Headers are matched by name in any case and order; ``datetime_utc`` goes before
    ``timestamp``. Missing columns and bad numbers are null; rows without a readable time are
    dropped. Of rows with one asset and time the last in file order wins, of several files
    that of the last name.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    names = F.transform(F.split(F.lower("header"), ","), lambda c: F.trim(F.translate(c, '"\ufeff', "")))
    rows = lines.join(heads, "file").where("value <> header AND trim(value) <> ''").withColumns({"names": names, "cells": F.split("value", ",")})

    def cell(name: str) -> Column:
        return F.trim(F.translate(F.get("cells", F.array_position("names", name).cast("int") - 1), '"', ""))

    when = F.coalesce(*[epoch_to_timestamp(cell(c)) for c in ("datetime_utc", "timestamp")])
    found = rows.select(F.regexp_extract("file", asset_pattern, 1).alias("asset"), when.alias("ts"), "file", "block", "line", *[cell(c).try_cast("double").alias(c) for c in columns]).where("ts IS NOT NULL")
    newest = Window.partitionBy("asset", "ts").orderBy(F.desc("file"), F.desc("block"), F.desc("line"))
    return found.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select("asset", "ts", *columns)


def read_klines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Bars of every CSV under ``path`` by :func:`read_series`: (asset, ts, KLINE_COLUMNS)."""
    return read_series(spark, path, KLINE_COLUMNS, **options)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The asset registry: a CSV with a header and a ``name`` column; a missing path or column is an error."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    if "name" not in rows.columns:
        raise ValueError(f"{path} has no column 'name'")
    return rows.withColumn("name", F.trim("name")).where("name <> ''")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def present(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """Which of the named folders or files exist and hold something: a decision made while a plan is built."""
    out = {}
    for name, path in paths.items():
        system, target = _file_system(spark, path)
        out[name] = bool(system.exists(target) and system.getContentSummary(target).getLength() > 0)
    return out


def lookup(spark: SparkSession, folder: str, name: str, endings: tuple[str, ...] = (".csv.gz", ".csv")) -> str | None:
    """The first of a name's files by ending, or None."""
    for ending in endings:
        system, target = _file_system(spark, f"{folder}/{name}{ending}")
        if system.exists(target):
            return f"{folder}/{name}{ending}"
    return None


_KEPT: dict[tuple[str, str], DataFrame] = {}


def cached(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame of a key, made once a session and kept in memory or on disk."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _KEPT:
        _KEPT[at] = make().persist()
    return _KEPT[at]


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, rows, first_ts, last_ts, bytes, digest) of every bar file; the digest is of lines and their number, in any order.

    Files are read in splits, so their size has no limit.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.split("value", ",")[0].alias("first"))
    stamped = lines.withColumn("ts", epoch_to_timestamp(F.col("first")))
    digest = F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "value").cast("decimal(38,0)")))
    return stamped.groupBy("file").agg(F.count("ts").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("bytes").alias("bytes"), digest.alias("digest"))


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok) of the sections of text bundles: ``### FILE name sha256`` and the lines up to the next one."""
    whole = spark.read.text(path, wholetext=True)
    section = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)### FILE (.*?)(?=### FILE |\z)"), 1)).alias("s")
    parts = whole.select(section).select(F.split(F.substring_index("s", "\n", 1), " ").alias("head"), F.expr("substr(s, locate('\n', s) + 1)").alias("body"))
    return parts.select(F.col("head")[0].alias("name"), (F.sha2("body", 256) == F.col("head")[1]).alias("ok"))


def read_unsealed(bars: DataFrame, sealed: list[str], before: int) -> DataFrame:
    """Refuse sealed assets and bars at or after the time seal: reading one raises."""
    name = F.regexp_replace(F.upper(F.trim("asset")), "USDT$", "")
    names = [s.strip().upper().removesuffix("USDT") for s in sealed]
    bad = name.isin(names) | (F.col("t") >= before)
    return bars.where(F.when(bad, F.raise_error(F.concat(F.lit("sealed data: "), F.col("asset")))).otherwise(F.lit(True)).cast("boolean"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("asset", "t")) -> DataFrame:
    """Union of two archives; of rows with the same keys the new one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]  # of equal keys in one archive the greatest row stays, whatever the order read
    latest = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in rest])
    return both.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_new")
