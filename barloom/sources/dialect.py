"""The few spots where Spark SQL and DuckDB spell one function differently."""

from __future__ import annotations

import re

#: Where values are cut into ranges; results do not depend on the exact edges.
_CENTILES = ", ".join(str(k / 100) for k in range(1, 100))
_SPARK = {
    "DAYS": "CAST(datediff(CAST({0} AS DATE), DATE '1970-01-01') AS BIGINT)",
    "HOURS": "(CAST(datediff(CAST({0} AS DATE), DATE '1970-01-01') AS BIGINT) * 24 + hour({0}))",
    "MONTHS": "CAST((year({0}) - 1970) * 12 + month({0}) - 1 AS BIGINT)",
    "KEY": "struct({0})",
    "PCTL": "percentile({0})",
    "SHA": "sha2({0}, 256)",
    "UNIT": "(CAST(conv(substring(md5({0}), 1, 12), 16, 10) AS DOUBLE) / 281474976710656e0)",
    "LISTOF": "collect_list({0})",
    "LEN": "size({0})",
    "KEEP": "filter({0}, x -> {1})",
    "TOTAL": "aggregate(transform({0}, x -> {1}), 0e0, (a, b) -> a + b)",
    "EACH": "transform({0}, x -> {1})",
    "LOWEST": "array_min({0})",
    "HIGHEST": "array_max({0})",
    "ORDERED": "sort_array({0})",
    "AT": "get({0}, {1} - 1)",
    "EDGES": f"approx_percentile({{0}}, array({_CENTILES}), 1000)",
    "SERIES": "explode(sequence({0}))",
    "SETTEXT": "array_join(sort_array(collect_set({0})), ',')",
    "TODATE": "date_add(DATE '1970-01-01', CAST({0} AS INT))",
}
_DUCK = {
    "DAYS": "CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT)",
    "HOURS": "(CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT) * 24 + hour({0}))",
    "MONTHS": "CAST((year({0}) - 1970) * 12 + month({0}) - 1 AS BIGINT)",
    "KEY": "row({0})",
    "PCTL": "quantile_cont({0})",
    "SHA": "sha256({0})",
    "UNIT": "(CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT) / 281474976710656e0)",
    "LISTOF": "list({0})",
    "LEN": "len({0})",
    "KEEP": "list_filter({0}, lambda x: {1})",
    "TOTAL": "list_sum(list_transform({0}, lambda x: {1}))",
    "EACH": "list_transform({0}, lambda x: {1})",
    "LOWEST": "list_min({0})",
    "HIGHEST": "list_max({0})",
    "ORDERED": "list_sort({0})",
    "AT": "list_extract({0}, {1})",
    "EDGES": f"quantile_cont({{0}}, [{_CENTILES}])",
    "SERIES": "unnest(generate_series({0}))",
    "SETTEXT": "string_agg(DISTINCT {0}, ',' ORDER BY {0})",
    "TODATE": "(DATE '1970-01-01' + CAST({0} AS INTEGER))",
}


def _translate(sql: str, table: dict[str, str]) -> str:
    """Replace NAME(arguments) by its pattern; arguments may hold balanced brackets, two are parted by a semicolon."""
    found = re.search(rf"\b({'|'.join(sorted(table, key=len, reverse=True))})\(", sql)
    if not found:
        return sql
    depth, at = 1, found.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[at], 0)
        at += 1
    inner = _translate(sql[found.end() : at - 1], table)
    return sql[: found.start()] + table[found[1]].format(*(p.strip() for p in inner.split(";"))) + _translate(sql[at:], table)


def to_spark(sql: str) -> str:
    return _translate(sql, _SPARK)


def to_duckdb(sql: str) -> str:
    return re.sub(r"\bAS STRING\b", "AS VARCHAR", _translate(sql, _DUCK))
