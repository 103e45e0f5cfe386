"""Queries of sources and sinks: each writes files of its own under the shared folder and reads them back."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import live, readers, sinks
from ..sources.bars import bars, bars_sql
from .functional import _query

_B2 = f"({bars_sql('B2')}) b"
_A = f"({bars_sql('A')}) b"
_ASSET = r"asset=([^/]+)"
_ROUND = "floor({0} * 1000000 + 0.5) / 1000000"


def _rounded(c: str) -> object:
    return (F.floor(F.col(c) * 1000000 + 0.5) / 1000000).alias(c)


def _files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Bar files of two layouts: full ones with both times, and older ones with other names, order and units."""
    root = sinks.work_folder(spark)
    rows = bars(spark, sf_dir, "B2").withColumn("seconds", F.col("t") * 86400)
    full = rows.where("asset = 'NO'").select("asset", (F.col("seconds") * 1000).alias("timestamp"), F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd HH:mm:ss").alias("datetime_utc"), "open", "high", "low", "close", "volume", "trades")
    old = rows.where("asset <> 'NO'").select("asset", F.col("volume").alias("Volume"), F.col("close").alias("Close"), F.col("low").alias("Low"), F.col("high").alias("High"), F.col("open").alias("Open"), (F.col("seconds") * 1000000).alias("Timestamp"))
    full.write.option("header", True).partitionBy("asset").csv(f"{root}/full")
    old.write.option("header", True).option("compression", "gzip").partitionBy("asset").csv(f"{root}/old")
    return [f"{root}/full/*", f"{root}/old/*"]


def _days(column: str = "ts") -> object:
    return F.expr(f"CAST(unix_seconds({column}) div 86400 AS BIGINT)").alias("t")


@_query("SRC01_registry", f"SELECT asset AS name, CASE WHEN count(*) > 100 THEN 'ok' ELSE 'thin' END AS status FROM {_B2} GROUP BY asset")
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_folder(spark)}/assets"
    rows = bars(spark, sf_dir, "B2").groupBy(F.concat(F.lit(" "), F.col("asset")).alias("Name")).agg(F.when(F.count(F.lit(1)) > 100, "ok").otherwise("thin").alias("Status"))
    rows.write.option("header", True).csv(path)
    return readers.read_registry(spark, path).select("name", "status")


@_query("SRC02_bar_files", f"SELECT asset, t, {_ROUND.format('open')} AS open, {_ROUND.format('high')} AS high, {_ROUND.format('close')} AS close, {_ROUND.format('volume')} AS volume, CASE WHEN asset = 'NO' THEN CAST(trades AS DOUBLE) END AS trades FROM {_B2}")
def _bar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.read_klines(spark, _files(spark, sf_dir), asset_pattern=_ASSET)
    return found.select("asset", _days(), *[_rounded(c) for c in ("open", "high", "close", "volume")], "trades")


@_query("SRC04_archive_files", "SELECT event_type AS asset, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, floor(max_by(value, event_id) * 1000000 + 0.5) / 1000000 AS funding_rate FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY event_id DESC) AS k FROM events) e WHERE k = 1 GROUP BY 1, 2")
def _archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in seconds, milliseconds or as text by turns; of rows with one time the last stays."""
    path = f"{sinks.work_folder(spark)}/funding"
    seconds = F.expr("CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT)")
    turn = F.pmod(F.col("event_id"), F.lit(3))
    when = F.when(turn == 0, seconds.cast("string")).when(turn == 1, (seconds * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("asset"), "event_id", when.alias("timestamp"), F.col("value").alias("funding_rate"))
    rows.repartition(1, "asset").sortWithinPartitions("event_id").drop("event_id").write.option("header", True).partitionBy("asset").csv(path)
    found = readers.read_series(spark, f"{path}/*", ("funding_rate",), asset_pattern=_ASSET)
    return found.select("asset", F.expr("CAST(unix_seconds(ts) AS BIGINT)").alias("sec"), _rounded("funding_rate"))


@_query("SRC07_file_lookup", "SELECT * FROM (VALUES ('a', 'csv.gz'), ('b', 'csv'), ('c', NULL)) v(name, kind)")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sinks.work_folder(spark)
    for path in ("a.csv", "a.csv.gz", "b.csv"):
        sinks.write_json(spark, f"{root}/{path}", {})
    found = [(n, p and p.removeprefix(f"{root}/{n}.")) for n in "abc" for p in [readers.lookup(spark, root, n)]]
    return spark.createDataFrame(found, "name string, kind string")


@_query("SRC08_loader_resample", f"SELECT asset, CAST(floor(t / 7e0) AS BIGINT) AS week, {_ROUND.format('min_by(open, t)')} AS open, {_ROUND.format('max(high)')} AS high, {_ROUND.format('min(low)')} AS low, {_ROUND.format('max_by(close, t)')} AS close FROM {_B2} GROUP BY 1, 2")
def _loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_klines(spark, _files(spark, sf_dir), asset_pattern=_ASSET).withColumn("t", _days())
    weeks = rows.groupBy("asset", F.floor(F.col("t") / 7).alias("week")).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"))
    return weeks.select("asset", "week", *[_rounded(c) for c in ("open", "high", "low", "close")])


def _archive(spark: SparkSession, sf_dir: str) -> str:
    root = sinks.work_folder(spark)
    rows = bars(spark, sf_dir, "B2").select("asset", "t", "trades")
    both = rows.withColumn("kind", F.lit("open_interest")).unionByName(rows.withColumn("kind", F.lit("funding")))
    both.write.partitionBy("kind", "asset").parquet(root)
    return root


@_query("SRC17_archive_load", f"SELECT asset, t, trades FROM {_B2} WHERE asset = 'NO'")
def _archive_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_archive(spark, sf_dir)).where("kind = 'funding' AND asset = 'NO'").select("asset", "t", "trades")


@_query("SRC28_symbol_archives", f"SELECT asset, count(*) AS n, max(t) AS last_t FROM {_B2} WHERE asset IN ('AF', 'RF') GROUP BY asset")
def _symbol_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(_archive(spark, sf_dir)).where("kind = 'open_interest'").where(F.col("asset").isin("AF", "RF"))
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))


@_query("SRC24_file_manifest", f"SELECT asset, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM {_B2} WHERE asset = 'NO' GROUP BY asset")
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.manifest(spark, _files(spark, sf_dir)[0]).where("bytes > 0 AND digest <> ''")
    whole = found.groupBy(F.regexp_extract("file", _ASSET, 1).alias("asset")).agg(F.sum("rows").alias("rows"), F.min("first_ts").alias("a"), F.max("last_ts").alias("b"))
    return whole.select("asset", "rows", _days("a").alias("first_t"), _days("b").alias("last_t"))


@_query("SRC25_bundle_verify", f"SELECT asset AS name, asset <> 'AF' AS ok FROM {_B2} GROUP BY asset")
def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_folder(spark)}/bundle"
    names = sorted(r.asset for r in bars(spark, sf_dir, "B2").select("asset").distinct().collect())
    body = {n: f"name,{n}\nrows,1\n" for n in names}
    text = "".join(f"### FILE {n} {hashlib.sha256(b.encode()).hexdigest() if n != 'AF' else '0'}\n{b}" for n, b in body.items())
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return readers.verify_bundle(spark, path)


@_query("SRC26_dataset_roundtrip", f"SELECT asset, t, {_ROUND.format('close')} AS close FROM {_B2}")
def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_folder(spark)}/dataset"
    sinks.write_dataset(bars(spark, sf_dir, "B2"), path)
    return spark.read.parquet(path).select("asset", "t", _rounded("close"))


@_query("SRC27_latest_copy", f"SELECT asset, t, trades + 1 AS trades FROM {_B2}")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = sinks.work_folder(spark), bars(spark, sf_dir, "B2").select("asset", "t", "trades")
    sinks.save_copies(rows, root, "2024-01-01")
    sinks.save_copies(rows.withColumn("trades", F.expr("trades + 1")), root, "2024-02-01")
    return sinks.load_latest(spark, root)


@_query("SNK02_stamped_copies", f"SELECT stamp, count(*) AS n FROM {_B2}, (VALUES ('a'), ('b')) v(stamp) GROUP BY stamp")
def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = sinks.work_folder(spark), bars(spark, sf_dir, "B2").select("asset", "t")
    for stamp in "ab":
        sinks.save_copies(rows, root, stamp)
    return spark.read.parquet(root).groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))


@_query("SRC29_directory_detection", "SELECT * FROM (VALUES ('empty', false), ('full', true), ('none', false)) v(name, present)")
def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sinks.work_folder(spark)
    spark.range(3).write.parquet(f"{root}/full")
    system, target = readers._file_system(spark, f"{root}/empty")
    system.mkdirs(target)
    return spark.createDataFrame(sorted(readers.present(spark, {n: f"{root}/{n}" for n in ("full", "empty", "none")}).items()), "name string, present boolean")


@_query("SRC30_read_cache", f"SELECT a.asset, count(*) AS n FROM {_B2} JOIN (SELECT DISTINCT asset FROM {_B2}) a ON a.asset = b.asset GROUP BY a.asset")
def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [readers.cached(spark, f"{sf_dir}:B2", lambda: bars(spark, sf_dir, "B2")) for _ in range(2)]
    if rows[0] is not rows[1]:
        raise AssertionError("a cached frame was made twice")
    return rows[0].join(rows[1].select("asset").distinct(), "asset").groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@_query("SRC32_export_readers", f"SELECT asset, t, trades FROM {_B2} WHERE t % 2 = 0")
def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = f"{sinks.work_folder(spark)}/export", bars(spark, sf_dir, "B2")
    sinks.export_unsealed(rows.where("t % 2 = 0").select("asset", "t", "trades"), spark.createDataFrame([("none",)], "asset string"), 10**6, path)
    return spark.read.parquet(path)


@_query("SNK01_dataset_writer", f"SELECT asset, count(*) AS n FROM {_B2} GROUP BY asset")
def _writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_folder(spark)}/dataset"
    sinks.write_dataset(bars(spark, sf_dir, "B2"), path)
    if not readers.lookup(spark, path, "_SUCCESS", ("",)):
        raise AssertionError("the dataset was not committed")
    return spark.read.parquet(path).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@_query("SNK03_asset_checkpoint", f"SELECT asset, asset <> 'NO' AS reused FROM {_B2} GROUP BY asset")
def _checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = f"{sinks.work_folder(spark)}/assets", bars(spark, sf_dir, "B2").select("asset", "t", "trades")
    build = lambda f: f.groupBy("asset").agg(F.sum("trades").alias("trades"))
    sinks.checkpoint_assets(rows, path, build, {"window": 3})
    return sinks.checkpoint_assets(rows.withColumn("trades", F.expr("CASE WHEN asset = 'NO' THEN trades + 1 ELSE trades END")), path, build, {"window": 3})


@_query("SNK04_fingerprints", f"SELECT name, sha256(name) AS print FROM (VALUES ('{{\"h\":1,\"w\":[8,32]}}'), ('{{}}')) v(name)")
def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, "B2")
    if sinks.fingerprint(rows) != sinks.fingerprint(rows.repartition(5)):
        raise AssertionError("a fingerprint depends on the order of rows")
    made = [('{"h":1,"w":[8,32]}', {"w": [8, 32], "h": 1}), ("{}", {})]
    return spark.createDataFrame([(n, sinks.settings_fingerprint(s)) for n, s in made], "name string, print string")


@_query("SNK05_ordered_merge", f"SELECT i, asset FROM (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM {_B2} GROUP BY asset) q")
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bars(spark, sf_dir, "B2").groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    numbered = names.selectExpr("CAST(row_number() OVER (ORDER BY asset) AS BIGINT) AS i", "asset")
    return sinks.spill_and_merge(numbered.repartition(3, "asset"), f"{sinks.work_folder(spark)}/parts", "i")


@_query("SNK06_report", f"SELECT asset, CAST(count(*) AS VARCHAR) AS n FROM {_B2} GROUP BY asset")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_folder(spark)}/report"
    sinks.report(bars(spark, sf_dir, "B2").groupBy("asset").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).csv(path)


@_query("SNK08_json_records", "SELECT * FROM (VALUES ('a', 1), ('b', 3)) v(name, version)")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sinks.work_folder(spark)
    for name, version in (("a", 1), ("b", 2), ("b", 3)):
        sinks.write_json(spark, f"{root}/{name}.json", {"name": name, "version": version})
    return spark.createDataFrame([(r["name"], r["version"]) for r in (sinks.read_json(spark, f"{root}/{n}.json") for n in "ab")], "name string, version int")


_SYMBOLS = [("AUSDT",), ("BUSDT",), ("CUSDT",)]


def _klines(symbol: str, start: int, limit: int) -> list[dict]:
    """A stand-in for an exchange: hours 5 to 2500, every 17th missing."""
    hours = [t for t in range(max(start, 5), 2501) if t % 17][:limit]
    return [{"t": t, "close": t * 0.5 + ord(symbol[0])} for t in hours]


_EXCHANGE = "SELECT symbol, t, t * 0.5e0 + ascii(symbol) AS close FROM (VALUES ('AUSDT'), ('BUSDT'), ('CUSDT')) s(symbol), generate_series({0}, {1}) g(t) WHERE t % 17 <> 0"


@_query("SRC11_paged_klines", _EXCHANGE.format(5, 2300))
def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.fetch(spark.createDataFrame(_SYMBOLS, "symbol string"), _klines, "t long, close double", start=0, end=2300, limit=500, calls=8000)


@_query("SRC12_symbol_listing", "SELECT * FROM (VALUES ('AUSDT', 'A'), ('CUSDT', 'C')) v(symbol, base)")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"symbol": "CUSDT", "status": "TRADING"}, {"symbol": "AUSDT", "status": "TRADING"}, {"symbol": "BUSDT", "status": "BREAK"}, {"symbol": "ABTC", "status": "TRADING"}]
    return live.listing(spark, lambda: rows)


@_query("SRC13_rate_limit", "SELECT i, 10e0 * floor(i / 3e0) AS at FROM generate_series(0, 19) g(i)")
def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty calls at once under a limit of 3 in 10 s, on a clock that only sleeping moves."""
    now = [0.0]
    limiter = live.RateLimiter(3, 10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    return spark.createDataFrame([(i, limiter.wait()) for i in range(20)], "i long, at double")


@_query("SRC14_funding_fetch", "SELECT symbol, t, (t % 9) / 10000e0 AS rate FROM (VALUES ('AUSDT'), ('BUSDT'), ('CUSDT')) s(symbol), generate_series(0, 400, 8) g(t)")
def _funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda symbol, start, limit: [{"t": t, "rate": (t % 9) / 10000} for t in range(-(-start // 8) * 8, 2000, 8)][:limit]
    return live.fetch(spark.createDataFrame(_SYMBOLS, "symbol string"), get, "t long, rate double", start=0, end=400, limit=20, calls=8000)


@_query("SRC15_interest_fetch", _EXCHANGE.format(1000, 2500).replace("close", "interest"))
def _interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumed from the last step that each symbol's archive holds."""
    known = spark.createDataFrame([(s, 1000) for (s,) in _SYMBOLS], "symbol string, from_t long")
    get = lambda symbol, start, limit: [{"t": r["t"], "interest": r["close"]} for r in _klines(symbol, start, limit)]
    return live.fetch(known, get, "t long, interest double", start=0, end=2500, limit=500, calls=8000)


@_query("SRC18_bulk_archives", "SELECT symbol, m AS period, CAST(count(*) AS BIGINT) AS n FROM (VALUES ('AUSDT'), ('BUSDT')) s(symbol), (VALUES ('2024-01', 31), ('2024-03', 31)) p(m, d), generate_series(1, 31) g(k) GROUP BY 1, 2")
def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly files; that of February does not exist."""
    files = spark.createDataFrame([(s, f"2024-0{m}") for s in ("AUSDT", "BUSDT") for m in (1, 2, 3)], "symbol string, period string")
    get = lambda symbol, period: None if period == "2024-02" else [{"day": d, "close": float(d)} for d in range(1, 32)]
    return live.fetch_files(files, get, "day long, close double").groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("n"))


@_query("SRC19_concurrent_download", f"SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ({_EXCHANGE.format(5, 2500)}) q GROUP BY symbol")
def _concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.fetch(spark.createDataFrame(_SYMBOLS, "symbol string"), _klines, "t long, close double", start=0, end=10**6, limit=700, tasks=3, calls=9000)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
