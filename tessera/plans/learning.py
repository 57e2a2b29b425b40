"""Pair features, models and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import similarity as sim
from tessera.functions import text as T
from tessera.operators import decision, features, learning, sampling
from tessera.plans.candidates import key_blocking_topk
from tessera.plans.fixtures import pairs
from tessera.plans.registry import query
from tessera.session import table, written

#: A word's code or skeleton has a letter at least and a blank before the next, so those of so many words fill what string
#: scorers see of texts that are cut. The queries here score whole texts.
SEEN_WORDS = features.SCORED_CHARS // 2 + 1


@query()
def isotonic_calibration(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    fold = sampling.crc_fold(F.col("q_id").cast("string"), 10)
    out = learning.calibrated(p.where(fold.isin(*learning.STAGE2)), p.select("p").distinct())
    return out.select("p", F.round("p_cal", 6).alias("p_cal"))


def normalised(spark: SparkSession, sf: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, src, ckey, h, normalised columns): documents, or those of ids (ckey, id), as business records, the first half of
    the words their name."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).alias("src"), F.col("lang").alias("ckey"), "text")
    if ids is not None:
        docs = docs.join(ids, ["ckey", "id"], "left_semi")
    docs = docs.select("id", "src", "ckey", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"), F.xxhash64("text").alias("h"))
    half = F.expr("(size(w) + 1) div 2")
    raw = docs.select("id", "src", "ckey", "h", F.array_join(F.slice("w", F.lit(1), half), " ").alias("name"), F.array_join(F.slice("w", half + 1, F.size("w")), " ").alias("addr"))
    return T.with_address(T.with_name(raw, "name"), "addr", F.lit("")).withColumn("n_translit", T.has_native(F.col("name"))).drop("name", "addr")


def pair_table(cand: DataFrame, norm: DataFrame) -> DataFrame:
    """Candidates with the columns of both records, of which those of src 1 ask; y where their texts are equal."""
    parts = [c for c in norm.columns if c not in ("id", "src", "ckey")]
    side = lambda s: norm.where(F.col("src") == 1 if s == "q" else F.col("src") != 1).select("ckey", F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in parts), *(["src"] if s == "i" else []))
    both = cand.join(side("q"), ["ckey", "q_id"]).join(side("i"), ["ckey", "i_id"])
    return both.withColumn("y", (F.col("q_h") == F.col("i_h")).cast("int"))


def featured(spark: SparkSession, sf: str, scores: tuple[str, ...] = tuple(sim.SCORES), vectors: tuple[str, ...] = features.VECTORS, names: bool = True) -> DataFrame:
    """Features of key blocking's candidates, of string scores and cosines those named, of counts of names all or none. All records count in frequencies;
    those that no candidate names need no more than the texts that are counted. Texts are scored whole."""
    cand = written(key_blocking_topk(spark, sf).select("ckey", "q_id", "i_id", F.col("score").alias("bscore"), "bits", F.col("rk").alias("brank")), "candidates")
    everyone = written(normalised(spark, sf).select("ckey", "id", "src", *features.vector_words(vectors).columns), "normalised")
    own = normalised(spark, sf, cand.select("ckey", F.explode(F.array("q_id", "i_id")).alias("id")).distinct())
    scored = {p for _, *of in sim.SCORES.values() for p in of} - {"n_core", "a_full"}
    needed = {p for s in scores for p in sim.SCORES[s][1:]}
    # written before a join on the name's digest: that it isn't null would be asked of the whole normaliser, below the rest
    own = written(features.lean(own.drop(*(scored - needed))), "records")
    held, known = features.rare_terms(own, everyone, vectors)
    whole = own.join(held, ["ckey", "id"], "left")
    if names:
        # an id's texts are told apart by their hashes, so that records needn't be dealt anew
        counts = F.struct("name_df_s1", "name_df_idx").alias("n")
        named = features.name_counts(own.select("ckey", "id", "h", "n_core"), everyone).groupBy("ckey", "id").agg(F.map_from_entries(F.collect_set(F.struct("h", counts))).alias("_n"))
        whole = whole.join(written(named, "named"), ["ckey", "id"]).withColumn("_n", F.try_element_at("_n", "h")).select("*", "_n.*").drop("_n")
    gate = (F.col("brank") < Config.fuzzy_gate) | (F.getbit("bits", F.lit(7)) == 1)
    out = features.cosines(pair_table(cand, whole), known, everyone, vectors)
    return features.context_features(features.dense_features(features.set_features(features.string_features(out, gate, scores, chars=None))))


@query()
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of candidate pairs: strings behind the gate, cosines, sets, bits, context."""
    out = featured(spark, sf)
    kept = ["q_id", "i_id", "y", *(c for c in (*features.BASE, *features.CONTEXT) if c in out.columns)]
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.select(*kept).dtypes))


@query()
def pair_classifier_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of a two-stage model: the second stage sees the first one's scores in their context."""
    feats = ["n_tset", "n_cos_word", "n_jacc", "n_ntok_diff", "a_tset", "a_num_jacc", "bscore", "brank", "b_ntypes"]
    rows = written(featured(spark, sf, ("n_tset", "a_tset"), ("n_cos_word",), names=False).select("q_id", "i_id", "y", *feats), "pairs")
    first = learning.out_of_fold(rows, feats, learning.STAGE1, rounds=Config.rounds, name="p1")
    second = decision.context(rows.join(first.select("q_id", "i_id", "p1"), ["q_id", "i_id"]), "p1")
    more = [*feats, "p1", "g_rank", "g_diff", "i_diff_other"]
    out = learning.out_of_fold(second.select("q_id", "i_id", "y", *more), more, learning.STAGE2, rounds=Config.rounds)
    return out.select("q_id", "i_id", "y", "fold", F.round("p", 6).alias("p"))
