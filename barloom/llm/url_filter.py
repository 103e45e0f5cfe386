"""URL filters: host and path rules, and association rules mined from what they label.

All of it is DataFrame functions: Spark's FP-growth mines token combinations of
labelled URLs, rules pruned by support and confidence are indexed by their
rarest token, and a URL meets a rule when it holds all tokens of it. A URL has one
token for each of its eight aspects; long paths and many parameters make long
tokens, not many, so the sets to mine do not multiply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hashes

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Tokens of one URL: so many at most, however long it is. A row of a table of N rows adds to 2^9 sets of tokens
#: and label, so at most 2^9 / MIN_SUPPORT = 102,400 sets are frequent at any N: mining ends, and rules are few.
TOKENS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "="


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host(url: str = "url") -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, ASCII lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null url or one without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: str, path: str, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; rules are a written list, so they are literals."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str, host: str, path: str) -> Column:
    """The distinct tokens of a URL, sorted; digits of paths are masked and aspects that are missing give none.

    Scheme, last label of the host, last two labels, whole host, first part of the path,
    whole path, extension, and the sorted names of all query parameters.
    """
    def aspect(tag: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(tag), value))

    masked = F.regexp_replace(F.col(path), "[0-9]+", "#")
    query = F.regexp_extract(F.col(url), r"(?s)\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=", 2)[0]), lambda x: x != ""))), "&")
    tokens = F.array(
        aspect("s:", F.regexp_extract(F.col(url), r"(?s)^(.*?)://", 1)),
        aspect("t:", F.substring_index(F.col(host), ".", -1)),
        aspect("d:", F.when(F.col(host).contains("."), F.substring_index(F.col(host), ".", -2))),
        aspect("h:", F.col(host)),
        aspect("f:", F.regexp_extract(masked, r"(?s)^/([^/]+)/", 1)),
        aspect("p:", masked),
        aspect("x:", F.regexp_extract(masked, r"(?s)\.([^./]+)$", 1)),
        aspect("q:", names),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull())))


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, partitions: int | None = None) -> DataFrame:
    """(items, key, verdict, confidence, support) of the rules that hold in rows (tokens, verdict).

    A rule's ``key`` is its rarest token. Without labelled rows there are none.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    empty = "items array<string>, key string, verdict string, confidence double, support long"
    if rows.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0, **({"numPartitions": partitions} if partitions else {})).fit(rows)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    label = F.filter("items", lambda x: x.startswith(_LABEL))
    named = sets.withColumn("label", label).withColumn("left", F.filter("items", lambda x: ~x.startswith(_LABEL)))
    rules = named.where("size(label) = 1 and size(left) > 0").select(F.col("left").alias("items"), F.substring(F.col("label")[0], 2, 1 << 20).alias("verdict"), F.col("freq").alias("support"))
    rules = rules.join(sets.withColumnRenamed("freq", "all"), "items").withColumn("confidence", F.col("support") / F.col("all")).where(F.col("confidence") >= min_confidence)
    single = sets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min(F.struct("freq", "token")).alias("r"))
    return cut(rules.join(rarest, "items").select("items", F.col("r.token").alias("key"), "verdict", "confidence", "support"))


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(k1, k2, mined) of rows (k1, k2, tokens) that some rule fits: the one of highest confidence, then support, then by name."""
    hits = token_sets.select("k1", "k2", "tokens", F.explode("tokens").alias("key")).join(F.broadcast(rules), "key").where(F.size(F.array_except("items", "tokens")) == 0)  # 102,400 rules at most: see TOKENS
    best = F.max(F.struct("confidence", "support", "verdict", F.array_join("items", " ").alias("items")))
    return hits.groupBy("k1", "k2").agg(best.alias("mined"))


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of every page.

    The longest explicit rule decides. Its verdicts label URLs for mining, and mined rules
    decide the rest; what none fits is allowed, and without labelled URLs nothing is mined.
    Of mined rules that fit, the one of highest confidence, then support counts; ties go to
    the greater verdict, then name. A null or empty url or one without ``://`` has empty host
    and path and no tokens. Long urls are read whole. Repeated rows each get the same
    verdict; other columns are not read, and an empty table gives no rows.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")).withColumns({"host": host(), "path": path()})
    own = own.withColumn("r", explicit_rule("host", "path", rules)).withColumn("tokens", F.when(F.col("host") != "", url_tokens("url", "host", "path")).otherwise(F.expr("cast(array() as array<string>)")))
    labelled = own.where("r is not null").select("tokens", F.col("r.verdict").alias("verdict"))
    mined = mine(labelled, min_support=min_support, min_confidence=min_confidence)
    # pages that a rule decided need no match; a key of their own keeps them from meeting in one task
    for name, own_key, shared in zip(("k1", "k2"), hashes("page_id", "url"), hashes("tokens"), strict=True):
        own = own.withColumn(name, F.when(F.col("r").isNull(), shared).otherwise(own_key))
    rest = own.where("r is null").select("k1", "k2", "tokens").distinct()
    found = match(rest, mined)
    out = own.join(found, ["k1", "k2"], "left").withColumn("mined", F.when(F.col("r").isNull(), F.col("mined")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("mined.verdict"), F.lit("allow")).alias("verdict"), F.col("mined.items").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))


def judge_sql(pages: str = "pages", rules: tuple[Rule, ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> str:
    """DuckDB SQL for :func:`judge` that counts every subset of every URL's tokens."""
    fits = "".join(f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r.name}', 'verdict': '{r.verdict}'}}" for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True))
    return rf"""WITH cut AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, row_number() OVER () AS k, strpos(coalesce(url, ''), '://') AS cut_at FROM {pages}),
        parts AS (SELECT *, CASE WHEN cut_at > 0 THEN left(url, cut_at - 1) ELSE '' END AS scheme, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest FROM cut),
        hosts AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
        asked AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS masked, regexp_extract(coalesce(url, ''), '\?([^#]*)', 1, 's') AS query, string_split(host, '.') AS labels, CASE{fits} END AS r FROM hosts),
        named AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''))), '&') AS params,
            CASE WHEN masked LIKE '/%' AND len(string_split(masked, '/')) > 2 THEN string_split(masked, '/')[2] ELSE '' END AS lead, regexp_extract(masked, '\.([^./]+)$', 1, 's') AS ext FROM asked),
        own AS (SELECT page_id, k, host, path, r, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter([
            CASE WHEN scheme <> '' THEN 's:' || scheme END, CASE WHEN labels[-1] <> '' THEN 't:' || labels[-1] END,
            CASE WHEN len(labels) > 1 THEN 'd:' || array_to_string(labels[-2:], '.') END, 'h:' || host, CASE WHEN lead <> '' THEN 'f:' || lead END,
            CASE WHEN masked <> '' THEN 'p:' || masked END, CASE WHEN ext <> '' THEN 'x:' || ext END, CASE WHEN params <> '' THEN 'q:' || params END], lambda x: x IS NOT NULL))) END AS tokens FROM named),
        subsets AS (SELECT o.k, o.r.verdict AS verdict, array_to_string(list_filter(o.tokens, lambda x, i: (m.m >> (i - 1)) & 1 = 1), ' ') AS items FROM own o JOIN range(1, 256) m(m) ON m.m < (1 << len(o.tokens))),
        counted AS (SELECT items, verdict, count(*) AS n FROM subsets WHERE verdict IS NOT NULL GROUP BY items, verdict),
        mined AS (SELECT * FROM (SELECT *, n / CAST(sum(n) OVER (PARTITION BY items) AS DOUBLE) AS confidence FROM counted) q WHERE n >= ceil({min_support} * (SELECT count(*) FROM own WHERE r IS NOT NULL)) AND confidence >= {min_confidence}),
        best AS (SELECT s.k, max(row(m.confidence, m.n, m.verdict, m.items)) AS b FROM subsets s JOIN mined m ON s.items = m.items WHERE s.verdict IS NULL GROUP BY s.k)
        SELECT o.page_id, o.host, o.path, o.r.rule AS rule, coalesce(o.r.verdict, m.verdict, 'allow') AS verdict, m.items AS mined_rule, m.confidence AS confidence
        FROM own o LEFT JOIN best b ON o.k = b.k LEFT JOIN mined m ON m.items = b.b[4] AND m.verdict = b.b[3]"""
