"""Learned studies on bars by the distributed estimators of pyspark.ml, and user functions over groups and batches.

Trees and clusters are fitted where the rows are; only models and small tables of
their results reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LAG, full, lag
from .relational import _op

FEATURES = ("r", "rng", "vol")
_LEARN = _op(
    "features",
    ({"r": f"close / {lag('close')} - 1", "rng": "(high - low) / close", "vol": "ln(1 + volume)", "fwd": f"lead(close) {LAG} / close - 1"}, "SELECT * FROM $in WHERE r IS NOT NULL AND fwd IS NOT NULL", {"label": "CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END"}),
    "asset", "t", *FEATURES, "fwd", "label",
)


def features(bars: DataFrame) -> DataFrame:
    """Features, the next return and its sign, with the features as one vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(_LEARN(bars))


def _fit(estimator, rows: DataFrame):
    """Fit over rows that are kept, on disk beyond memory, while the estimator passes over them."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def regimes(bars: DataFrame, k: int = 3) -> DataFrame:
    """Clusters of standardised features with the mean next return of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    rows = features(bars)
    scaled = _fit(StandardScaler(inputCol="x", outputCol="z", withMean=True), rows).transform(rows)
    model = _fit(KMeans(featuresCol="z", predictionCol="regime", k=k, seed=7), scaled)
    return model.transform(scaled).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean_fwd"))


def importances(bars: DataFrame) -> DataFrame:
    """Mean importance of each feature over a forest and boosted trees, with its rank."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = features(bars)
    made = [_fit(e(featuresCol="x", labelCol="fwd", maxDepth=3, seed=7, **p), rows).featureImportances.toArray() for e, p in ((RandomForestRegressor, {"numTrees": 10}), (GBTRegressor, {"maxIter": 5}))]
    mean = sum(made) / len(made)
    order = sorted(range(len(FEATURES)), key=lambda i: (-mean[i], FEATURES[i]))
    return bars.sparkSession.createDataFrame([(FEATURES[i], float(mean[i]), k + 1) for k, i in enumerate(order)], "feature string, importance double, k int")


def leaves(bars: DataFrame, until: int, depth: int = 3) -> DataFrame:
    """Leaves of a tree fitted up to a step, with the share of successes before and after it and the later one's z score."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = features(bars)
    model = _fit(DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, seed=7).setLeafCol("leaf"), rows.where(F.col("t") <= until))
    later, total = F.col("t") > until, F.col("label")
    found = model.transform(rows).groupBy("leaf").agg(F.count_if(~later).alias("n_fit"), F.avg(F.when(~later, total)).alias("p_fit"), F.count_if(later).alias("n_later"), F.avg(F.when(later, total)).alias("p_later"))
    base = rows.where(later).agg(F.avg("label").alias("base"))
    z = (F.col("p_later") - F.col("base")) / F.sqrt(F.nullif(F.col("base") * (1 - F.col("base")), F.lit(0.0)) / F.nullif(F.col("n_later"), F.lit(0)))
    return found.crossJoin(F.broadcast(base)).select("leaf", "n_fit", "p_fit", "n_later", "p_later", (F.col("p_fit") - F.col("p_later")).alias("gap"), z.alias("z"))


def boosted_deciles(bars: DataFrame, until: int) -> DataFrame:
    """Mean next return after a step by the tenth of the probability that boosted trees, fitted up to it, give."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows = features(bars)
    model = _fit(GBTClassifier(featuresCol="x", labelCol="label", maxDepth=3, maxIter=5, seed=7), rows.where(F.col("t") <= until))
    scored = model.transform(rows.where(F.col("t") > until)).withColumn("p", vector_to_array("probability")[1])
    return scored.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean_fwd"))


def calibrated(bars: DataFrame, until: int) -> DataFrame:
    """Platt scaling: a logistic fit of the outcome on the last return up to a step, applied after it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = features(bars)
    model = _fit(LogisticRegression(featuresCol="x", labelCol="label", maxIter=20), rows.where(F.col("t") <= until))
    return model.transform(rows.where(F.col("t") > until)).select("asset", "t", vector_to_array("probability")[1].alias("p"), "label")


def score_batches(frame: DataFrame, score: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """Rows with the score of a user's model, called on Arrow batches of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: score(batch).astype("float64")})

    return frame.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + f", `{name}` double")


def by_group(frame: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function of one group's rows; a group must fit one executor's memory."""
    return frame.groupBy(*keys).applyInPandas(function, schema)


def predict_splits(frame: DataFrame, keys: list[str], predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function of the train and the later rows of each key."""
    train, rest = frame.where("part = 'train'"), frame.where("part <> 'train'")
    return train.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInPandas(predict, schema)


def ordered_map(frame: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str]) -> DataFrame:
    """A function of batches, its rows numbered in the input's order: places within a key's rows plus the counts of keys before it."""
    from pyspark.sql import Window

    done = frame.mapInPandas(lambda batches: (function(b) for b in batches), schema)
    lead, rest = order[0], order[1:] or order
    counts = done.groupBy(lead).agg(F.count(F.lit(1)).alias("m"))
    before = counts.select(lead, (F.sum("m").over(Window.orderBy(lead)) - F.col("m")).alias("before"))  # one row a key
    return done.join(before, lead).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy(lead).orderBy(*rest))).drop("before").orderBy("i")


def rolling_apply(frame: DataFrame, column: str, rows: int, function: Callable[[pd.Series], float], name: str, keys: str = "asset", order: str = "t") -> DataFrame:
    """A user's function of the last rows of each key, called on Arrow slices of its frames."""
    from pyspark.sql import Window
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(values: pd.Series) -> float:
        return function(values)

    return frame.withColumn(name, run(column).over(Window.partitionBy(keys).orderBy(order).rowsBetween(1 - rows, 0)))


def success_patterns(bars: DataFrame, depth: int = 3, k: int = 4) -> DataFrame:
    """(kind, pattern, n, success): leaves of a tree and clusters with the share of rows whose next return is positive, and how far apart rows lie.

    ``outlier`` is the share of rows beyond three mean distances from their cluster's centre.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    rows = features(bars)
    tree = _fit(DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, seed=7).setLeafCol("leaf"), rows)
    scaled = _fit(StandardScaler(inputCol="x", outputCol="z", withMean=True), rows).transform(rows)
    model = _fit(KMeans(featuresCol="z", predictionCol="cluster", k=k, seed=7), scaled)
    leaves_ = tree.transform(rows).groupBy(F.col("leaf").cast("long").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("success")).select(F.lit("leaf").alias("kind"), "pattern", "n", "success")
    placed = model.transform(scaled)
    groups = placed.groupBy(F.col("cluster").cast("long").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("success")).select(F.lit("cluster").alias("kind"), "pattern", "n", "success")
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array("z"), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    far = placed.withColumn("gap", gap)
    mean = far.agg(F.avg("gap").alias("mean"))
    outliers = far.crossJoin(F.broadcast(mean)).where("gap > 3 * mean").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("success")).select(F.lit("outlier").alias("kind"), F.lit(0).cast("long").alias("pattern"), "n", "success")
    return leaves_.unionByName(groups).unionByName(outliers)


def attributions(bars: DataFrame) -> DataFrame:
    """(feature, loss): how much the squared error of a linear scorer grows when one feature is dealt anew among the rows."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    rows = features(bars)
    model = _fit(LinearRegression(featuresCol="x", labelCol="fwd"), rows)
    weights = [float(w) for w in model.coefficients]
    x = vector_to_array("x")
    # dealing a feature anew adds twice its part's variance less its part's bond with the error: exact in expectation, one pass
    error = F.col("fwd") - model.intercept - sum((x[i] * w for i, w in enumerate(weights)), F.lit(0.0))
    found = rows.agg(*[(2 * w * w * F.var_pop(x[i]) + 2 * w * F.covar_pop(x[i], error)).alias(FEATURES[i]) for i, w in enumerate(weights)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("loss")) for n in FEATURES])).alias("r")).select("r.*")
