"""Fitting and applying match models: grouped folds, out-of-fold scores, calibration."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import crc_fold
from tessera.session import written

#: Logits and gaps, the lowest features, stay above it.
MISSING = -1000.0
#: Models fitted at a time; a fit is many short jobs.
FITS = 2
STAGE1, STAGE2, HOLDOUT = (0, 1, 2), (3, 4, 5, 6, 7), (8, 9)


def with_missing_flags(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Trees here have no missing values: nulls become MISSING, below every feature's range, and get a flag."""
    flags = {f"{f}_missing": F.col(f).isNull().cast("double") for f in features}
    casts = {f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features}
    return rows.withColumns(flags).withColumns(casts), [*features, *flags]


def classifier(features: list[str], label: str = "y", rounds: int = 20, depth: int = 4) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.75, seed=7)])


def fit_folds(rows: DataFrame, features: list[str], folds: tuple[int, ...], rounds: int = 10, depth: int = 4) -> dict[int, PipelineModel]:
    """A model for each fold that takes part, fitted on the others of them. rows: (q_id, y, features)."""
    data, names = with_missing_flags(rows.withColumn("fold", fold_of()), features)
    fit = lambda f: classifier(names, rounds=rounds, depth=depth).fit(data.where(F.col("fold").isin(*(x for x in folds if x != f))))
    with ThreadPool(min(FITS, len(folds))) as pool:
        return dict(zip(folds, pool.map(inheritable_thread_target(rows.sparkSession)(fit), folds), strict=True))


def fold_of(entity: str = "q_id") -> Column:
    return crc_fold(F.col(entity).cast("string"), 10)


def scored(rows: DataFrame, features: list[str], models: dict[int, PipelineModel], name: str = "p") -> DataFrame:
    """rows with the score, a column of a new name, of the model that didn't see the row's fold or, for other folds, the
    mean of all."""
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    data, _ = with_missing_flags(rows.withColumn("_fold", fold_of()), features)
    own = data.select("q_id", "i_id", "_fold", *[c for c in data.columns if c in features or c.endswith("_missing")])
    for fold, model in models.items():
        own = model.transform(own).withColumn(f"_p{fold}", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    mean = reduce(lambda x, y: x + y, (F.col(f"_p{f}") for f in models)) / len(models)
    p = reduce(lambda rest, f: F.when(F.col("_fold") == f, F.col(f"_p{f}")).otherwise(rest), models, mean)
    return rows.join(own.select("q_id", "i_id", p.alias(name)), ["q_id", "i_id"])


def out_of_fold(rows: DataFrame, features: list[str], folds: tuple[int, ...], rounds: int = 10, name: str = "p") -> DataFrame:
    """(q_id, i_id, y, fold, score). Folds are by query, so no query is on both sides."""
    rows = written(rows, "pairs")
    return scored(rows, features, fit_folds(rows, features, folds, rounds), name).select("q_id", "i_id", "y", fold_of().alias("fold"), name)


def calibrated(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with p_cal, the isotonic fit of y on p; outside the range seen, its ends."""
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(train.select("p", F.col("y").cast("double").alias("y")))
    return model.transform(rows).withColumnRenamed("prediction", "p_cal")


def shortlist(pairs: DataFrame, least: float = 0.02, n: int | None = None, p: str = "p") -> DataFrame:
    """The pairs that a second scorer looks at: of each index record the best query's, if its score reaches least; with n,
    the n best of all, ties by ids."""
    w = Window.partitionBy("i_id").orderBy(F.desc(p), "q_id")
    out = pairs.withColumn("_rk", F.row_number().over(w)).where((F.col("_rk") == 1) & (F.col(p) >= least)).drop("_rk")
    return out if n is None else out.orderBy(F.desc(p), "q_id", "i_id").limit(n)


def reranked(pairs: DataFrame, scores: DataFrame, weight: float, least: float = 0.02) -> DataFrame:
    """pairs with p blended with the raw scores (q_id, i_id, logit) of those on the shortlist."""
    own = shortlist(pairs, least).select("q_id", "i_id").join(scores.select("q_id", "i_id", sigmoid(F.col("logit")).alias("_other")), ["q_id", "i_id"])
    return pairs.join(own, ["q_id", "i_id"], "left").withColumn("p", blended("p", "_other", weight)).drop("_other")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blended(p: str, other: str, weight: float) -> Column:
    """Linear blend of two scores where the second exists."""
    return F.when(F.col(other).isNull(), F.col(p)).otherwise((1 - weight) * F.col(p) + weight * F.col(other))
