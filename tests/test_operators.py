"""Every operator against its oracle on the smallest tables, and known outcomes."""

import math

import duckdb
import pytest

from barloom.functions import normalize, registry
from barloom.operators.core import Operator
from barloom.operators.recursions import BLOCK, Scan, ema
from barloom.operators.studies import _PAV
from barloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders", "part")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def _close(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-5, abs_tol=3e-5) for p, q in zip(x, y)) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert _close(_rows(found.columns, [tuple(r) for r in found.collect()]), _rows(names, expected.fetchall()))


def test_ema_by_hand(spark):
    bars = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 10.0)], "asset string, t long, c double")
    scan = Scan("x", (), ("c",), {"e": ("NULL", ema("r.c", "e", 3))}, ("e",))
    assert [r["e"] for r in scan(bars).orderBy("t").collect()] == [10.0, 15.0, 12.5]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_learned_studies_give_rows(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert len(found) and not found.columns.duplicated().any()


def test_scan_across_blocks(spark):
    n = 2 * BLOCK + 3
    bars = spark.range(n).selectExpr("'a' AS asset", "id AS t", "CAST(1 AS DOUBLE) AS c")
    found = Scan("x", (), ("c",), {"s": ("0", "s.s + r.c")}, ("s",))(bars).orderBy("t").collect()
    assert [(r["t"], r["s"]) for r in found] == [(k, k + 1.0) for k in range(n)]


def test_isotonic_by_hand(spark):
    rows = spark.createDataFrame([("val", b, 10, s, 0.0, 0.0) for b, s in enumerate((1.0, 5.0, 3.0, 9.0))], "part string, b long, n long, s double, p double, brier double")
    found = Operator("x", (_PAV,), ("b", "iso"))(rows).orderBy("b").collect()
    assert [r["iso"] for r in found] == pytest.approx([0.1, 0.4, 0.4, 0.9])


def test_registry(spark):
    bars = spark.createDataFrame([("a", 2.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0), ("c", None, 1.0, 1.0)], "asset string, high double, low double, close double")
    assert [r[0] for r in registry.apply_filter(bars, "relative_range").collect()] == ["a"]
    with pytest.raises(KeyError):
        registry.apply_filter(bars, "unknown")
    with pytest.raises(ValueError):
        registry.sample_filter("relative_range")(registry._relative_range)
    with pytest.warns(UserWarning):
        assert registry.select_available(bars, ["low", "x"]).columns == ["low"]
    assert registry.drop_matching(bars, ["h*", "low"]).columns == ["asset", "close"]
    assert normalize.kinds(["ret_1", "ret_z_1", "oi_available", "x"], {"ret": "return", "ret_z": "score"}, "level") == {"return": ["ret_1"], "score": ["ret_z_1"], "level": ["oi_available", "x"]}
    assert normalize.kinds(["BBP_5", "oi_available", "x"]) == {"unit_0_1": ["BBP_5"], "binary_flag": ["oi_available"], "cumulative": ["x"]}
    assert (registry.required_bars([30, 55], 3, 4), registry.embargo([30, 12], 24, 3), registry.embargo([], 24, 3)) == (223, 33, 26)
