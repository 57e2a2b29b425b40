"""Reports on list files: score, blocking quality, caps, and a hold-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics, sampling
from tessera.sources import lists

CAPS = {2: 5, 3: 6}


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, i_id) of a list file, repeated ids once."""
    return lists.read_id_lists(spark, path).select(F.col("s1").alias("q_id"), F.explode(F.array_distinct("ids")).alias("i_id"))


def _entities(spark: SparkSession, truth: str, source: str | None) -> DataFrame:
    """(q_id, truth, segment) of all entities of the truth, without matches too; the segment is the country."""
    rows = lists.read_id_lists(spark, truth).select(F.col("s1").alias("q_id"), F.size(F.array_distinct("ids")).alias("truth"))
    if source is None:
        return rows.withColumn("segment", F.lit("?"))
    return rows.join(lists.read_source(spark, source).select(F.col("entity_id").alias("q_id"), F.lower("country").alias("segment")), "q_id", "left").na.fill({"segment": "?"})


def score(spark: SparkSession, truth: str, predicted: str, source: str | None = None) -> DataFrame:
    """The score report by country and for all; entities that aren't predicted count as empty."""
    right = _pairs(spark, truth).withColumn("y", F.lit(1))
    chosen = _pairs(spark, predicted).join(right, ["q_id", "i_id"], "left").na.fill({"y": 0})
    return metrics.score_report(metrics.entity_counts(_entities(spark, truth, source), chosen))


def blocking(spark: SparkSession, truth: str, candidates: str, n_index: int) -> DataFrame:
    entities = _entities(spark, truth, None).select("q_id")
    return metrics.blocking_report(_pairs(spark, truth), _pairs(spark, candidates).join(entities, "q_id", "left_semi"), entities, n_index)


def caps(spark: SparkSession, truth: str, predicted: str) -> DataFrame:
    named = lambda path, kind: _pairs(spark, path).select("q_id", F.substring("i_id", 2, 1).cast("int").alias("src"), F.lit(kind).alias("kind"))
    return metrics.cap_violations(named(truth, "truth").unionByName(named(predicted, "predicted")), CAPS)


def owners(spark: SparkSession, truth: str) -> DataFrame:
    """Index records that several entities claim."""
    return metrics.claimed_by_several(_pairs(spark, truth))


def holdout(spark: SparkSession, truth: str, share: float) -> DataFrame:
    """The entities that a deterministic hold-out takes."""
    return sampling.holdout(_entities(spark, truth, None), "q_id", share).select("q_id")


def errors(spark: SparkSession, truth: str, predicted: str, candidates: str, source: str | None = None, examples: str | None = None) -> DataFrame:
    """Wrong pairs by class and country; with a path, all of them are written there as tab-separated text."""
    entities = _entities(spark, truth, source)
    items = metrics.error_items(*(_pairs(spark, p).join(entities.select("q_id"), "q_id", "left_semi") for p in (truth, predicted, candidates)))
    if examples:
        items.select(F.concat_ws("\t", "class", "q_id", "i_id").alias("value")).orderBy("value").write.mode("overwrite").text(examples)
    return metrics.error_taxonomy(items, entities)


def sampled_lists(spark: SparkSession, path: str, share: int = 1, restrict: DataFrame | None = None) -> DataFrame:
    """(q_id, ids) of a list file, with or without header: of the entities in restrict (q_id), if given, one in share
    by a hash of the id."""
    rows = lists.read_id_lists(spark, path).select(F.col("s1").alias("q_id"), "ids")
    rows = rows if restrict is None else rows.join(restrict.select("q_id").distinct(), "q_id", "left_semi")
    return rows.where(sampling.bucket(F.col("q_id"), share) == 0) if share > 1 else rows


def blocking_by_source(spark: SparkSession, truth: str, candidates: str, source: str | None = None) -> DataFrame:
    """(segment, src, n_truth, n_found, recall): which true pairs were candidates, by country, by source and for all."""
    offered = _pairs(spark, candidates).distinct().withColumn("hit", F.lit(1))
    pairs = _pairs(spark, truth).join(offered, ["q_id", "i_id"], "left").join(_entities(spark, truth, source).select("q_id", "segment"), "q_id")
    named = pairs.select(F.explode(F.array(F.lit("ALL"), F.col("segment"))).alias("segment"), F.substring("i_id", 1, 2).alias("s"), "hit").select("segment", F.explode(F.array(F.lit("ALL"), F.col("s"))).alias("src"), "hit")
    return named.groupBy("segment", "src").agg(F.count("*").alias("n_truth"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def checked(spark: SparkSession, path: str, header: str, source: str, index: list[str], candidates: str | None = None) -> DataFrame:
    """list_checks of a list file against the records of the sources."""
    rows = lists.read_id_rows(spark, path)
    required = lists.read_source(spark, source).select(F.col("entity_id").alias("s1"))
    known = None
    for p in index:
        one = lists.read_source(spark, p).select(F.col("entity_id").alias("id"))
        known = one if known is None else known.unionByName(one)
    offered = _pairs(spark, candidates).select(F.col("q_id").alias("s1"), F.col("i_id").alias("id")) if candidates else None
    return lists.list_checks(rows, required, known, offered)
