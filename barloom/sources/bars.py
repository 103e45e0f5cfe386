"""Bar frames from event-like tables: (asset, t, open, high, low, close, volume, trades).

``t`` counts steps (days, hours or months) since 1970-01-01, so results do not
depend on a session's time zone. A bar exists where its step has rows with a price;
a price that is not positive is missing, so returns and logarithms are defined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .dialect import to_duckdb, to_spark


@dataclass(frozen=True)
class Mapping:
    """How a table becomes bars: SQL for the asset, the step, the price, the volume and a total order within a step."""

    tables: tuple[str, ...]
    source: str
    asset: str
    step: str
    price: str
    volume: str
    order: str

    def sql(self) -> str:
        rows = f"SELECT {self.asset} AS asset, {self.step} AS t, {self.price} AS p, {self.volume} AS v, {self.order} FROM {self.source}"
        return f"""SELECT asset, t, min_by(p, KEY({self.order}, p)) AS open, max(p) AS high, min(p) AS low, max_by(p, KEY({self.order}, p)) AS close,
            floor(sum(v) * 1000 + 0.5) / 1000e0 AS volume, count(*) AS trades FROM ({rows}) q WHERE p > 0 GROUP BY asset, t"""


_LINE = "l_extendedprice / l_quantity"
MAPPINGS = {
    "A": Mapping(("events",), "events", "CAST(user_id AS STRING)", "DAYS(ts)", "value", "value", "event_id"),
    "A2": Mapping(("events",), "events", "event_type", "HOURS(ts)", "value", "value", "event_id"),
    "B": Mapping(("lineitem",), "lineitem", "CAST(l_suppkey AS STRING)", "DAYS(l_shipdate)", _LINE, "l_quantity", "l_orderkey, l_linenumber"),
    "B2": Mapping(("lineitem",), "lineitem", "concat(l_returnflag, l_linestatus)", "DAYS(l_shipdate)", _LINE, "l_quantity", "l_orderkey, l_linenumber"),
    "B3": Mapping(("lineitem",), "lineitem", "CAST(l_suppkey AS STRING)", "MONTHS(l_shipdate)", _LINE, "l_quantity", "l_orderkey, l_linenumber"),
    "C": Mapping(("orders",), "orders", "o_orderpriority", "DAYS(o_orderdate)", "o_totalprice", "o_totalprice", "o_orderkey"),
}


def bars(spark: SparkSession, sf_dir: str, mapping: str) -> DataFrame:
    """Bars of one of the :data:`MAPPINGS` from the tables of a folder."""
    m = MAPPINGS[mapping]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in m.tables}
    text = to_spark(m.sql()).replace(f"FROM {m.source})", f"FROM {{{m.tables[0]}}})")
    return spark.sql(text, **frames)


def bars_sql(mapping: str) -> str:
    return to_duckdb(MAPPINGS[mapping].sql())
