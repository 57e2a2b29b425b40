"""Deterministic folds, sub-worlds and samples: hashes of ids, never random generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crc_fold(entity_id: Column, n: int = 10, salt: str = "") -> Column:
    return F.pmod(F.crc32(F.concat(F.lit(salt), entity_id).cast("binary")), F.lit(n)).cast("int")


def sub_world(query: DataFrame, index: DataFrame, owners: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Queries (q_id) by their hash; index rows (i_id) of kept owners, and unowned ones by their own hash.
    owners: (i_id, q_id)."""
    limit = int(share * 1000)
    kept = query.where(crc_fold(F.col("q_id").cast("string"), 1000, "dev") < limit)
    owned = index.join(owners.select("i_id", "q_id"), "i_id", "left").join(kept.select(F.col("q_id"), F.lit(True).alias("_kept")), "q_id", "left")
    free = F.col("q_id").isNull() & (crc_fold(F.col("i_id").cast("string"), 1000, "devx") < limit)
    return kept, owned.where(F.coalesce("_kept", F.lit(False)) | free).select(index.columns).distinct()


def hard_negatives(pairs: DataFrame, hardness: Column, n: int) -> DataFrame:
    """All positives (y = 1) and the n hardest negatives; ties by ids."""
    negatives = pairs.where("y = 0").withColumn("_h", hardness).orderBy(F.desc("_h"), "q_id", "i_id").limit(n).drop("_h")
    return pairs.where("y = 1").unionByName(negatives)


def weighted_sample(rows: DataFrame, weight: Column, key: Column, k: int) -> DataFrame:
    """k rows without replacement, chances by weight: the largest u^(1/w) of a hash u of the key."""
    u = (F.pmod(F.xxhash64(key), F.lit(1 << 31)) + 1) / F.lit(float((1 << 31) + 1))
    return rows.where(weight > 0).withColumn("_e", -F.ln(u) / weight).orderBy("_e", key).limit(k).drop("_e")


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Drops empty keys, then keeps the first row of each key."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.where(F.col(key) != "").withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def bucket(entity_id: Column, n: int) -> Column:
    """A deterministic bucket below n."""
    return F.pmod(F.xxhash64(entity_id), F.lit(n)).cast("int")


def holdout(entities: DataFrame, key: str, share: float) -> DataFrame:
    """One bucket of max(2, round(1 / share))."""
    return entities.where(bucket(F.col(key), max(2, round(1 / share))) == 0)


def group_subsample(pairs: DataFrame, key: str, share: float) -> DataFrame:
    """All pairs of a share of the groups."""
    return pairs.where(bucket(F.col(key), 1_000_000) < int(share * 1_000_000))
