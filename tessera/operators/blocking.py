"""Candidates by compound keys: pairs of rare tokens, weighted by inverse frequency.

A key's use is bounded before the join: it must be in at most max_df index records, and its share of the join,
index records times query records, must be at most max_pairs. So no key can make a task large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tokens
from tessera.session import written

#: Partitions (countries) that blank rows may be replicated to.
MOST_PARTITIONS = 10_000
FAMILIES = {"NT": 0, "NS": 1, "AN": 2, "NH": 3, "NP": 4, "NC": 5, "PH": 6, "DENSE": 7, "BM25": 8}
MAX_DF = {"NP": 200, "NC": 200}


def rarest(records: DataFrame, families: dict[str, int], keep: list[str], words: tokens.Words | None = None) -> DataFrame:
    """(keep, <family>): of each family, an array column or what words finds, the k rarest tokens that at least two records
    of the partition have, rarest first, ties by the token. Frequencies are counted by tasks; a record's frequent tokens
    beyond its k rarest of them make no row. keep: the partition, the record's id and what else names it."""
    part, record = keep[0], keep
    words = words or tokens.of_arrays(tuple(families))
    df = written(tokens.frequencies(records, part, words), "frequencies")
    rows = tokens.contenders(records, record, words, families, tokens.frequent(df))
    w = Window.partitionBy(*record, "family").orderBy("df", "tok")
    ranked = rows.join(df, [part, "family", "tok"]).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max(families.values()))
    held = ranked.groupBy(*record).agg(F.array_sort(F.collect_list(F.struct("family", "rk", "tok"))).alias("t"))
    cut = lambda f, k: F.transform(F.filter("t", lambda x: (x["family"] == f) & (x["rk"] <= k)), lambda x: x["tok"])
    return held.select(*record, *(cut(f, k).alias(f) for f, k in families.items()))


def _pair(a: Column, b: Column, family: str) -> Column:
    return F.struct(F.lit(family).alias("family"), a.alias("a"), b.alias("b"))


def _crossed(left: str, right: Column, family: str) -> Column:
    """Every pair of a left and a right token, within the row."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: _pair(x, y, family))))


def compound_keys(records: DataFrame, name_topk: int = 2, addr_topk: int = 4, num_topk: int = 2, words: tokens.Words | None = None) -> DataFrame:
    """(ckey, id, side, family, a, b) of all families that the records have columns for, or that words finds. records:
    (ckey, id, side, core, alpha, and of skel, askel, phon, nums arrays and concat, those that exist); nums and concat take
    part unranked."""
    keep = ["ckey", "id", "side"]
    ranks = {"core": 3, "skel": name_topk, "phon": name_topk, "alpha": addr_topk, "askel": 3}
    rare = rarest(records, {f: k for f, k in ranks.items() if f in (words.families if words else records.columns)}, keep, words)
    out = records.select(*keep, *(c for c in ("nums", "concat") if c in records.columns)).join(rare, keep, "left")
    first = lambda c, k: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, k)
    has = out.columns
    cut = {"core2": ("core", name_topk), "alpha3": ("alpha", 3), "num2": ("nums", num_topk)}
    out = out.withColumns({**{f: first(f, k) for f, k in ranks.items() if f in has}, **{n: first(c, k) for n, (c, k) in cut.items() if c in has}})
    parts = [("core2", "alpha", "NT"), ("skel", "askel", "NS"), ("num2", "alpha3", "AN"), ("core2", "num2", "NH"), ("phon", "askel", "PH")]
    keys = [_crossed(a, F.col(b), f) for a, b, f in parts if a in out.columns and b in out.columns]
    keys.append(F.flatten(F.transform("core", lambda x: F.transform(F.filter("core", lambda y: x < y), lambda y: _pair(x, y, "NP")))))
    if "concat" in has:
        keys.append(F.when(F.col("concat") != "", F.array(_pair(F.col("concat"), F.lit(""), "NC"))).otherwise(F.array().cast("array<struct<family:string,a:string,b:string>>")))
    return out.select(*keep, F.explode(F.concat(*keys)).alias("k")).select(*keep, "k.family", "k.a", "k.b")


def key_stats(query: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """df of each key on both sides, and whether it may be used."""
    di = index.groupBy(*keys).agg(F.count("*").alias("df_i"))
    dq = query.groupBy(*keys).agg(F.count("*").alias("df_q"))
    return di.join(dq, keys)


def usable(stats: DataFrame, max_df: int = 500, max_pairs: int = 50_000) -> DataFrame:
    cap = F.coalesce(*(F.when(F.col("family") == f, F.lit(n)) for f, n in MAX_DF.items()), F.lit(max_df))
    return stats.where((F.col("df_i") <= cap) & (F.col("df_i") * F.col("df_q") <= max_pairs))


def key_candidates(query: DataFrame, index: DataFrame, n_index: DataFrame, k: int, part: str = "ckey", max_df: int = 500, max_pairs: int = 50_000) -> DataFrame:
    """(part, q_id, i_id, score, bits, n_families, rk): the best k per query by the sum of log1p(n / df_i) over
    shared keys. query and index: (part, id, family, a, b); n_index: (part, n)."""
    keys = [part, "family", "a", "b"]
    weights = usable(key_stats(query, index, keys), max_df, max_pairs).join(n_index, part).select(*keys, F.log1p(F.col("n") / F.col("df_i")).alias("w"))
    bit = F.coalesce(*(F.when(F.col("family") == f, F.lit(1 << b)) for f, b in FAMILIES.items()))
    joined = query.join(weights, keys).join(index, keys)
    scored = joined.groupBy(part, "q_id", "i_id").agg(F.round(F.sum("w"), 6).alias("score"), F.bit_or(bit).alias("bits"))
    scored = scored.withColumn("n_families", F.bit_count("bits"))
    w = Window.partitionBy(part, "q_id").orderBy(F.desc("score"), F.desc("n_families"), "i_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def replicated(rows: DataFrame, partitions: DataFrame, part: str = "ckey") -> DataFrame:
    """Rows of a blank partition stay there and go to every other one, so that an equi-join on it suffices: a query of
    a blank partition meets blank rows only. partitions: the values of the query side; their number is collected as one
    array, bounded by MOST_PARTITIONS."""
    values = [r[0] for r in partitions.select(part).where(F.col(part) != "").distinct().limit(MOST_PARTITIONS + 1).collect()]
    if len(values) > MOST_PARTITIONS:
        raise ValueError(f"over {MOST_PARTITIONS} partitions")
    blank = F.array(*(F.lit(v) for v in sorted([*values, ""])))
    to = F.when(F.col(part) == "", blank).otherwise(F.array(F.col(part)))
    return rows.withColumn(part, F.explode(to)).select(rows.columns)


def merged(candidates: DataFrame, extra: DataFrame, family: str, k: int) -> DataFrame:
    """Union of candidate lists: bits are joined, scores and ranks of the first list stay, a pair that only the
    second has gets score 0 and rank k + 50."""
    bit = 1 << FAMILIES[family]
    both = candidates.join(extra.select("q_id", "i_id", F.lit(bit).alias("_bit")), ["q_id", "i_id"], "full")
    return both.select(
        "q_id", "i_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("_bit", F.lit(0))).alias("bits"), F.coalesce("rk", F.lit(k + 50)).alias("rk"),
    )
