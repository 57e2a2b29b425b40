"""A corpus from raw documents to token ids, in five stages.

Each stage takes all that its predecessor kept and returns the columns of documents, the last one token ids.
Stages are written as Parquet in the shared folder and read again. Rows without a doc_id can't be named by a
join and pass the stages that drop documents by id; documents that share an id fall or stay together in language ID.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, ngram_join, pii
from tessera.llm.common import table, written
from tessera.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't identified."""
    ship(spark)
    files = 1 + docs.count() // (1 << 17)
    found = langid.identified(langid.document_rows(docs), langid.train(docs, "doc_id"))
    rejected = found.groupBy("key").agg(F.max("accepted").alias("any")).where("not any")
    ids = rejected.select(F.substring("key", 2, 30).try_cast("long").alias("doc_id")).dropna()
    return ngram_join.join_ids(docs, written(ids, "rejected", files), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group that n-gram links connect. Where an id names several
    rows, they are told apart by their sets: of equal rows, and of rows that link, the first by text stays."""
    ship(spark)
    files = 1 + docs.count() // (1 << 17)
    found = written(ngram_join.grouped(docs), "groups", files)
    repeated = written(docs.dropna(subset=["doc_id"]).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated", files)
    drop = found.where("component_id <> doc_id").select("doc_id").unionByName(repeated).distinct()
    kept = ngram_join.join_ids(docs, written(drop, "copies", files), "left_anti")
    if not repeated.take(1):
        return kept
    names, own = docs.columns, [f"_{k}" for k in range(len(docs.columns))]
    rows = ngram_join.with_hashes(ngram_join.join_ids(docs, repeated, "left_semi")).toDF(*own, "_high", "_low")
    key, text = own[names.index("doc_id")], own[names.index("text")]
    sets = ngram_join.join_ids(found, repeated, "left_semi").where("component_id = doc_id").select(F.col("doc_id").alias("_of"), F.col("group_id").alias("_group"), F.col("high").alias("_h"), F.col("low").alias("_l")).distinct()
    joined = rows.join(sets, (rows[key] == sets["_of"]) & (rows["_high"] == sets["_h"]) & (rows["_low"] == sets["_l"]))
    first = joined.groupBy("_of", "_group").agg(F.min(F.struct(text, "_high", "_low", F.xxhash64(*own).alias("_row"))).alias("_first"))
    once = joined.withColumn("_row", F.xxhash64(*own)).join(first.select(F.col("_group").alias("_g"), "_of", F.col("_first._row").alias("_r")), ["_of"]).where("_group = _g and _row = _r")
    return kept.unionByName(once.dropDuplicates(["_of", "_group", "_row"]).select(*own).toDF(*names))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    ship(spark)
    done = pii.pseudonymised(docs, counts=False)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and the ids."""
    ship(spark)
    return bpe.round_trip(docs, *bpe.default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("surrogates", surrogates),
    ("tokens", tokens),
]

#: SQL can't express these stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
