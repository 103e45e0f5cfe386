"""Sinks: committed datasets, fingerprinted checkpoints, locked exports and append-only ledgers."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _file_system, present


def fingerprint(frame: DataFrame) -> str:
    """Order-free content hash: count and sum of row hashes over columns by name."""
    columns = sorted(frame.columns)
    n, total = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in columns]).cast("decimal(38,0)"))).first()
    return f"{n}:{total}:{','.join(columns)}"


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a local one in local runs."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="barloom-")
    return f"{base}/work-{uuid.uuid4().hex}"


def write_dataset(frame: DataFrame, path: str, partition: str | None = "asset") -> None:
    """Parquet with Spark's commit protocol: a reader sees all of it or, without _SUCCESS, knows it is partial.

    Rows of a partition value are brought together first, so each gets few files; AQE splits large ones.
    """
    if partition:
        frame.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
    else:
        frame.write.mode("overwrite").parquet(path)


def save_copies(frame: DataFrame, root: str, stamp: str) -> None:
    """The dataset under its stamp, written once, and as the latest one."""
    frame.write.mode("overwrite").parquet(f"{root}/stamp={stamp}")
    write_json(frame.sparkSession, f"{root}.latest.json", {"stamp": stamp})


def load_latest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/stamp={read_json(spark, f'{root}.latest.json')['stamp']}")


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    """A small record, written beside its place and moved there, so readers see the old or the new one."""
    system, target = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"{path} could not be written")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def settings_fingerprint(settings: dict) -> str:
    """SHA-256 of settings in one spelling: sorted names, no blanks."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checkpoint_assets(frame: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], settings: dict, asset: str = "asset") -> DataFrame:
    """Per-asset results, built anew only where the asset's rows or the settings changed; (asset, reused) of all assets.

    Results are one partition an asset with the fingerprint they were built from.
    """
    spark, mark = frame.sparkSession, settings_fingerprint(settings)
    content = F.sum(F.xxhash64(*[F.col(c).cast("string") for c in sorted(frame.columns)]).cast("decimal(38,0)")).cast("string")
    prints = frame.groupBy(asset).agg(F.sha2(F.concat_ws(":", F.lit(mark), F.count(F.lit(1)), content), 256).alias("print"))
    known = spark.read.parquet(path).select(asset, "print").distinct() if present(spark, {"": path})[""] else spark.createDataFrame([], prints.schema)
    state = prints.join(known.select(asset, "print", F.lit(True).alias("reused")), [asset, "print"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    decided = f"{path}.state-{uuid.uuid4().hex}"  # written down: the folder that it was read from changes below
    state.write.parquet(decided)
    state = spark.read.parquet(decided)
    built = build(frame.join(state.where("NOT reused").select(asset), asset, "left_semi")).join(state.select(asset, "print"), asset)
    built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(asset).parquet(path)
    return state.select(asset, "reused")


def spill_and_merge(frame: DataFrame, path: str, order: str) -> DataFrame:
    """Parts written as they come and read back in the input's order."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path).orderBy(order)


def report(frame: DataFrame, path: str, preview: int = 20) -> str:
    """Write a report as CSV; returns its first rows as text."""
    frame.write.mode("overwrite").option("header", True).csv(path)
    return frame.limit(preview).toPandas().to_string(index=False)


def export_unsealed(frame: DataFrame, sealed: DataFrame, before: int, path: str) -> None:
    """Write what neither the list of sealed assets nor the time seal covers."""
    frame.join(sealed.select("asset").distinct(), "asset", "left_anti").where(F.col("t") < before).write.mode("overwrite").parquet(path)


def append_ledger(old: DataFrame, new: DataFrame, key: str = "t", value: str = "pnl", tolerance: float = 1e-9) -> DataFrame:
    """Old rows must be unchanged, null values may be filled, new keys are added; a changed value raises. A null key is a key like others."""
    o, n = F.col(f"o.{value}"), F.col(f"n.{value}")
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    changed = o.isNotNull() & n.isNotNull() & (F.abs(o - n) > tolerance)
    held = F.when(changed, F.raise_error(F.lit("a settled ledger row changed")).cast("double")).otherwise(F.coalesce(o, n))
    return joined.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), held.alias(value))
