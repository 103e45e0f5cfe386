"""Queries on inputs that the small tables do not hold, against their SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import pairs
from barloom.operators.permutations import draws, order
from barloom.plans.catalog import ORACLES, QUERIES
from barloom.sources.bars import bars
from barloom.streaming.bars import event_stream, run_once, sessions


def _events(folder, rows):
    """``rows``: SQL of (ts, user_id, value)."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT row_number() OVER () - 1 AS event_id, ts, CAST(user_id AS BIGINT) AS user_id, 'view' AS event_type, CAST(value AS DOUBLE) AS value, '{{}}' AS props FROM ({rows}) r(ts, user_id, value)) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_ledger_days_at_midnight(spark, tmp_path):
    """Parts of a second about midnight, days before 1970 and unknown times."""
    times = [f"TIMESTAMP '{d} {s}'" for d in ("2024-01-02", "1969-12-30", "1969-12-31", "1970-01-01") for s in ("00:00:00", "00:00:00.5", "10:00:00", "23:59:58.5", "23:59:59.499999", "23:59:59.5", "23:59:59.9")]
    con = _events(tmp_path, f"SELECT unnest([{', '.join(times)}, NULL, NULL]), 1, 1")
    expected = con.execute(ORACLES["STR07_forward_ledger"]).fetchall()
    assert (None, 2.0) in expected
    assert _sorted(QUERIES["STR07_forward_ledger"](spark, str(tmp_path)).select("t", "pnl").collect()) == _sorted(expected)


def test_paired_join_of_many_assets(spark, tmp_path):
    """Only rows of the two assets meet: joined by step alone, 3000 assets a day make 9 million rows a day."""
    con = _events(tmp_path, "SELECT TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(i % 5 AS INT)), i // 5, 1 + i % 7 FROM range(15000) g(i)")
    found = QUERIES["JOIN10_paired_inner"](spark, str(tmp_path))
    rows = found.collect()
    assert len(rows) == 5 and _sorted(rows) == _sorted(con.execute(ORACLES["JOIN10_paired_inner"]).fetchall())
    assert max(_metrics(found._jdf.queryExecution().executedPlan(), "Join", "numOutputRows")) <= 5 * 3000


def _metrics(plan, kind, metric):
    """A metric of all nodes of a kind that ran."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _metrics(plan.executedPlan(), kind, metric)
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _metrics(plan.plan(), kind, metric)
    own = [plan.metrics().apply(metric).value()] if kind in plan.nodeName() and plan.metrics().contains(metric) else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in _metrics(children.apply(i), kind, metric)]


def test_stream_results_stay_out_of_the_driver(spark, tmp_path):
    """The sessions are files that executors read, not a table in the driver's memory, and a stream that runs again gives them all."""
    con = _events(tmp_path, "SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(40 * (i % 9) AS INT)), i // 9, 1 FROM range(900) g(i)")
    found = QUERIES["STR09_sessions"](spark, str(tmp_path))
    assert found.inputFiles() and "LocalTableScan" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert _sorted(found.collect()) == _sorted(con.execute(ORACLES["STR09_sessions"]).fetchall())
    spark.read.parquet(f"{tmp_path}/events.parquet").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        found = run_once(sessions(event_stream(spark, f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))), "again", f"{tmp_path}/state")
    assert found.count() == con.execute(f"SELECT count(*) FROM ({ORACLES['STR09_sessions']}) s").fetchone()[0]


def test_permutations_shuffle_the_table_once(spark, tmp_path):
    """1000 replicas of 400 rows: no exchange writes more than a few times the table."""
    con = _events(tmp_path, "SELECT TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(i % 22 AS INT)), i // 22, 1 + (i * 7919 % 1013) / 7 FROM range(440) g(i)")
    found = QUERIES["BST01_permutation"](spark, str(tmp_path))
    rows, expected = found.collect(), con.execute(ORACLES["BST01_permutation"]).fetchall()
    assert rows[0]["n"] == 400 and [tuple(r) for r in rows] == [pytest.approx(e, abs=2e-6) for e in expected]
    assert max(_metrics(found._jdf.queryExecution().executedPlan(), "Exchange", "shuffleRecordsWritten")) <= 2000


def test_draws_are_those_of_the_sql():
    n = 100_100
    for k in (1, 77, 1000):
        found = draws(n, k)
        assert all(int(found[i - 1]) == int(hashlib.md5(f"{i}:{k}".encode()).hexdigest()[:12], 16) for i in (1, 9, 10, 99, 100, 999, 1000, 32768, 32769, 99_999, 100_000, n))
    close = found & ~np.uint64((1 << 30) - 1) | np.arange(n, dtype=np.uint64) * np.uint64(7919) % np.uint64(3)
    for draw in (found, close):  # also where draws agree but in their last bits, or in all
        assert (order(draw) == np.argsort(draw, kind="stable")).all()
    assert list(order(found[:1])) == [0]


def test_pairs_shuffle_the_panel_once(spark, tmp_path):
    """40 assets in 10 blocks, one without a name: every pair, and no exchange writes an asset once for each block."""
    con = _events(tmp_path, "SELECT TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(i % 20 AS INT)), nullif(i // 20, 40), 1 + (i * 7919 % 1013) / 7 FROM range(820) g(i)")
    found = pairs.all_correlations(bars(spark, str(tmp_path), "A"), assets=4)
    rows, expected = found.collect(), con.execute(ORACLES["AGG11_pair_correlation"]).fetchall()
    assert len(rows) == len(expected) == 780
    assert {(r.a, r.b): (r.n, r.rho) for r in rows} == {(a, b): (n, pytest.approx(rho, abs=2e-6)) for a, b, n, rho in expected}
    assert _metrics(found._jdf.queryExecution().executedPlan(), "CartesianProduct", "numOutputRows")
    assert max(_metrics(found._jdf.queryExecution().executedPlan(), "Exchange", "shuffleBytesWritten")) <= 30_000


def test_pairs_of_equal_series_are_runs(spark, tmp_path):
    """8 series of 12 assets each and one that does not move of 40, more than a block: every pair as in the SQL, and pairs of equal series one after another."""
    con = _events(tmp_path, "SELECT TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(i % 20 AS INT)), i // 20, CASE WHEN i < 1920 THEN 1 + ((i // 20 % 8 * 20 + i % 20) * 7919 % 1013) / 7 ELSE 5 END FROM range(2720) g(i)")
    found = pairs.all_correlations(bars(spark, str(tmp_path), "A"), assets=16, digits=6)
    rows, expected = found.collect(), con.execute(ORACLES["AGG11_pair_correlation"]).fetchall()
    assert len(rows) == len(expected) == 136 * 135 // 2 and any(np.isnan(rho) for *_, rho in expected)
    assert {(r.a, r.b): (r.n, r.rho) for r in rows} == {(a, b): (n, pytest.approx(rho, abs=2e-6, nan_ok=True)) for a, b, n, rho in expected}
    moving = [r.rho for r in rows if not np.isnan(r.rho)]
    assert sum(x != y for x, y in zip(moving, moving[1:])) < len(moving) / 3
