import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.sources.readers import epoch_to_timestamp, manifest, read_klines, read_unsealed, upsert
from barloom.sources.sinks import append_ledger, fingerprint, write_dataset
from barloom.streaming.bars import closed_bars, event_stream, run_once, running_ema, sessions


def test_epochs(spark):
    rows = spark.createDataFrame([("1700000000",), ("1700000000000",), ("1700000000000000",), ("1700000000000000000",), ("2023-11-14 22:13:20",), ("bad",)], "v string")
    found = [r[0] for r in rows.select(epoch_to_timestamp(F.col("v")).cast("string")).collect()]
    assert found == ["2023-11-14 22:13:20"] * 5 + [None]


def test_klines(spark, tmp_path):
    (tmp_path / "BTC.csv").write_text("timestamp,Open,high,low,close,volume\n1700000000000,1,2,0,1,5\n1700000000000,1,2,0,3,5\nbad,1,1,1,1,1\n")
    found = read_klines(spark, str(tmp_path)).collect()
    assert [(r.asset, r.close, r.trades) for r in found] == [("BTC", 3.0, None)]
    # mixed layouts: every file is read by its own header
    (tmp_path / "AAA.csv").write_text("timestamp,datetime_utc,open,high,low,close,volume,trades\n1,2023-11-14 22:13:20,1,2,0.5,1.5,7,3\n")
    (tmp_path / "BBB.csv").write_text("Close,timestamp,Open,High,Low,Volume\n9,1700000000,8,10,7,\n\n")
    rows = {r.asset: r for r in read_klines(spark, str(tmp_path)).collect()}
    assert rows["AAA"].ts == rows["BBB"].ts == rows["BTC"].ts
    assert (rows["BBB"].open, rows["BBB"].high, rows["BBB"].low, rows["BBB"].close, rows["BBB"].volume, rows["AAA"].trades) == (8, 10, 7, 9, None, 3)
    for name in ("AAA", "BBB"):
        (tmp_path / f"{name}.csv").unlink()
    assert manifest(spark, str(tmp_path)).count() == 1


def test_seal_and_upsert(spark):
    bars = spark.createDataFrame([("A", 1, 1.0), ("B", 2, 1.0)], "asset string, t long, c double")
    assert read_unsealed(bars, ["Z"], 10).count() == 2
    with pytest.raises(PySparkException):
        read_unsealed(bars, ["ausdt"], 10).collect()
    new = spark.createDataFrame([("A", 1, 2.0), ("C", 1, 3.0)], "asset string, t long, c double")
    assert sorted(map(tuple, upsert(bars, new).collect())) == [("A", 1, 2.0), ("B", 2, 1.0), ("C", 1, 3.0)]


def test_ledger_and_fingerprint(spark, tmp_path):
    old = spark.createDataFrame([(1, 1.0), (2, None)], "t long, pnl double")
    new = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None)], "t long, pnl double")
    assert sorted(map(tuple, append_ledger(old, new).collect())) == [(1, 1.0), (2, 5.0), (3, None)]
    with pytest.raises(PySparkException):
        append_ledger(old, spark.createDataFrame([(1, 9.0)], "t long, pnl double")).collect()
    assert fingerprint(old) == fingerprint(old.orderBy(F.desc("t"))) != fingerprint(new)
    write_dataset(new, str(tmp_path / "d"), None)
    assert fingerprint(spark.read.parquet(str(tmp_path / "d"))) == fingerprint(new)


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=20 * i), 1, "x", float(i)) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    found = run_once(closed_bars(event_stream(spark, str(tmp_path / "in"))), "bars", str(tmp_path / "c1")).orderBy("ts").collect()
    assert [(r.open, r.close, r.trades) for r in found][:2] == [(0.0, 2.0, 3), (3.0, 5.0, 3)]
    assert closed_bars(events).count() == 4
    assert sessions(events).collect()[0]["events"] == 12
    found = run_once(running_ema(event_stream(spark, str(tmp_path / "in"))), "ema", str(tmp_path / "c2"), "update").collect()
    assert found[0]["n"] == 12
