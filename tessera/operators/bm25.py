"""BM25 as a join of query terms with term rows of the index, then a top-k per query.

Terms in over max(50, max_df_ratio * n) records weigh nothing and leave before the join. A query's terms count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

K1, B = 1.2, 0.75


def term_weights(index: DataFrame, query_terms: DataFrame, floor: int = 50, max_df_ratio: float = 0.2, part: tuple[str, ...] = ()) -> DataFrame:
    """(part, i_id, tok, w) of the query's terms; the statistics are those of each partition. index: (part, i_id, toks);
    query_terms: (part, tok). One exploded table, written once, gives tf and df."""
    part = list(part)
    rows = index.select(*part, "i_id", F.size("toks").alias("len"), F.explode("toks").alias("tok"))
    tf = rows.join(query_terms.select(*part, "tok").distinct(), [*part, "tok"], "left_semi").groupBy(*part, "i_id", "len", "tok").agg(F.count("*").alias("tf"))
    tf = written(tf, "terms")
    stats = index.groupBy(*part).agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    df = tf.groupBy(*part, "tok").agg(F.count("*").alias("df"))
    df = df.join(stats, part) if part else df.join(F.broadcast(stats))
    df = df.where(F.col("df") <= F.greatest(F.lit(float(floor)), max_df_ratio * F.col("n")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return tf.join(df, [*part, "tok"]).select(*part, "i_id", "tok", weight.alias("w"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(q_id, i_id, score, rk): the best k sums of weights per query. hits: (q_id, i_id, w)."""
    scored = hits.groupBy("q_id", "i_id").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "i_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def top_k(query: DataFrame, index: DataFrame, k: int, floor: int = 50, max_df_ratio: float = 0.2, part: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, i_id, score, rk) of the best within each query's partition. query: (part, q_id, toks)."""
    terms = query.select(*part, "q_id", F.explode(F.array_distinct("toks")).alias("tok"))
    return ranked(terms.join(term_weights(index, terms, floor, max_df_ratio, part), [*part, "tok"]), k)


def keep_by_rank(ranked: DataFrame, special: str, k: int, k_special: int) -> DataFrame:
    """Ranks up to k, and up to k_special where the flag column holds."""
    return ranked.where((F.col("rk") <= k) | (F.col(special) & (F.col("rk") <= k_special)))
