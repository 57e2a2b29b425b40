"""The whole linkage: three sources in, matched and candidate lists out.

prepare -> block -> featurise -> train or predict -> decide. Tables are cut at the same places where a run would
resume: normalised records, pairs with features, scores. Countries are an open set and part of every join key.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, enforce
from tessera.functions import text as T
from tessera.functions.words import DEFAULT, Tables
from tessera.operators import blocking, bm25, decision, dense, features, learning, metrics, tokens
from tessera.session import finished, kept, ship, written
from tessera.sources import lists

STAGE1 = [*features.BASE, *features.CONTEXT]
STAGE2 = [*features.SECOND, *features.CORE]


def normalise(source: DataFrame, tables: Tables = DEFAULT) -> DataFrame:
    """A source with the normalised columns and its partition key."""
    folded = source.withColumn("_name", T.ascii_folded("business_name")).withColumn("_addr", T.ascii_folded("business_address"))
    out = T.with_address(T.with_name(folded, "_name", tables), "_addr", F.col("country"), tables)
    out = out.withColumn("n_phon", T.nysiis_words("n_core")).withColumn("n_translit", T.has_native(F.col("business_name"))).withColumn("a_translit", T.has_native(F.col("business_address")))
    return out.withColumn("ckey", F.lower(F.trim("country"))).drop("_name", "_addr")


@dataclass
class World:
    """Normalised query and index records, the truth (q_id, i_id) if known, and vectors (id, v) if there are any."""

    query: DataFrame
    index: DataFrame
    truth: DataFrame | None
    vectors: DataFrame | None = None


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def prepare(spark: SparkSession, folder: str, split: str, tables: Tables = DEFAULT) -> World:
    """Reads {split}_source1..3.tsv and, where they are there, {split}_ground_truth.tsv and {split}_vectors.parquet,
    columns (id, v) with a normalised vector for each entity id."""
    ship(spark)
    s1, s2, s3 = (lists.read_source(spark, f"{folder}/{split}_source{k}.tsv") for k in (1, 2, 3))
    query = written(normalise(s1, tables).withColumnRenamed("entity_id", "q_id"), "query")
    index = written(normalise(lists.index_relation(s2, s3), tables).drop("pos").withColumnRenamed("entity_id", "i_id"), "index")
    path, truth = f"{folder}/{split}_ground_truth.tsv", None
    if _there(spark, path):
        named = lists.read_id_lists(spark, path).select(F.col("s1").alias("q_id"), F.explode(F.array_distinct("ids")).alias("i_id"))
        named = written(named, "named")
        truth = written(named.join(query.select("q_id"), "q_id", "left_semi").join(index.select("i_id"), "i_id", "left_semi"), "truth")
        if unknown := named.count() - truth.count():
            warnings.warn(f"{unknown} pairs of the ground truth name unknown records and are dropped", stacklevel=2)
    vectors = f"{folder}/{split}_vectors.parquet"
    return World(query, index, truth, spark.read.parquet(vectors).select("id", "v") if _there(spark, vectors) else None)


def key_rows(world: World, config: Config) -> tuple[DataFrame, DataFrame]:
    """Compound keys (ckey, id, family, a, b) of both sides. Frequencies count both; rows of a blank country are in
    every other partition."""
    index = blocking.replicated(world.index, world.query.select("ckey").distinct())
    cols = ["ckey", "n_core", "n_skel", "n_phon", "n_concat", "a_alpha", "a_skel", "a_nums"]
    both = world.query.select(F.col("q_id").alias("id"), F.lit("q").alias("side"), *cols).unionByName(index.select(F.col("i_id").alias("id"), F.lit("i").alias("side"), *cols))
    split = {"core": "n_core", "skel": "n_skel", "phon": "n_phon", "alpha": "a_alpha", "askel": "a_skel", "nums": "a_nums"}
    rows = both.select("ckey", "id", "side", F.col("n_concat").alias("concat"), *(features.words(F.col(c)).alias(n) for n, c in split.items()))
    keys = written(blocking.compound_keys(rows, config.name_topk, config.addr_topk, config.num_topk), "keys")
    return tuple(keys.where(F.col("side") == s).drop("side").withColumnRenamed("id", f"{s}_id") for s in "qi")


def block(world: World, config: Config, run: str | None = None) -> DataFrame:
    """(q_id, i_id, bscore, bits, brank): compound keys, BM25 and, with vectors, nearest neighbours, within partitions."""
    if (done := finished(world.query.sparkSession, run, "candidates")) is not None:
        return done
    q, i = key_rows(world, config)
    index = blocking.replicated(world.index, world.query.select("ckey").distinct())
    n = index.groupBy("ckey").agg(F.count("*").alias("n"))
    keyed = blocking.key_candidates(q, i, n, config.k_key, max_df=config.max_df, max_pairs=config.max_pairs_per_key).select("q_id", "i_id", "score", "bits", "rk")
    terms = F.array_distinct(F.concat(*(tokens.prefixed(features.words(F.col(c)), p) for c, p in (("n_core", "n:"), ("a_core", "a:"))), tokens.prefixed(tokens.char_ngrams(F.col("n_concat"), 4), "g:")))
    own = lambda df, key: df.select("ckey", key, terms.alias("toks"))
    ranked = bm25.top_k(own(world.query, "q_id"), own(index, "i_id"), config.k_bm25_empty, part=("ckey",))
    ranked = ranked.join(world.index.select("i_id", "a_empty"), "i_id")
    extra = bm25.keep_by_rank(ranked, "a_empty", config.k_bm25, config.k_bm25_empty)
    merged = blocking.merged(keyed, extra, "BM25", config.k_key)
    if world.vectors is not None:
        script = T.non_latin(F.col("business_name")).alias("native")
        side = lambda df, key: df.join(world.vectors, df[key] == world.vectors["id"]).select(key, "ckey", "v")
        near = dense.top_k(side(world.query, "q_id"), side(index, "i_id"), config.k_dense_script)
        native = near.join(world.query.select("q_id", script), "q_id").join(world.index.select("i_id", script.alias("i_native")), "i_id")
        chosen = bm25.keep_by_rank(native.withColumn("native", F.col("native") | F.col("i_native")), "native", config.k_dense, config.k_dense_script)
        merged = blocking.merged(merged, chosen, "DENSE", config.k_key)
    return kept(merged.select("q_id", "i_id", F.col("score").alias("bscore"), "bits", F.col("rk").alias("brank")), run, "candidates")


def featurise(world: World, candidates: DataFrame, config: Config, run: str | None = None) -> DataFrame:
    """Candidates with the stage-1 features and, where the truth is known, y. Frequencies are those of a partition."""
    if (done := finished(world.query.sparkSession, run, "features")) is not None:
        return done
    index = blocking.replicated(world.index, world.query.select("ckey").distinct())
    parts = [c for c in world.query.columns if c.startswith(("n_", "a_"))]
    records = world.query.select("ckey", F.col("q_id").alias("id"), F.lit(1).alias("src"), "n_core", "a_full").unionByName(index.select("ckey", F.col("i_id").alias("id"), F.col("src").cast("int").alias("src"), "n_core", "a_full"))
    known = written(features.attributes(records), "attributes")
    own = [c for c in known.columns if c not in ("ckey", "id")]
    side = lambda df, s: df.select("ckey", f"{s}_id", *(F.col(c).alias(f"{s}_{c}") for c in parts), *(["src"] if s == "i" else [])).join(known.select("ckey", F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in own)), ["ckey", f"{s}_id"])
    pairs = candidates.join(side(world.query, "q"), "q_id").join(side(index, "i"), ["ckey", "i_id"])
    gate = (F.col("brank") < config.fuzzy_gate) | (F.getbit("bits", F.lit(7)) == 1)
    out = features.string_features(pairs, gate)
    state = F.when((F.col("q_a_state") != "") & (F.col("i_a_state") != ""), (F.col("q_a_state") == F.col("i_a_state")).cast("int"))
    out = features.set_features(out).withColumn("a_state_eq", state).withColumn("i_addr_translit", F.col("i_a_translit").cast("int"))
    out = features.context_features(features.dense_features(out, world.vectors))
    if world.truth is not None:
        out = out.join(world.truth.withColumn("_y", F.lit(1)), ["q_id", "i_id"], "left").withColumn("y", F.coalesce("_y", F.lit(0)))
    named = ["q_id", "i_id", *STAGE1, "combo", "q_a_first_num", "i_a_first_num", "i_n_core", "i_a_full", *(["y"] if world.truth is not None else [])]
    return kept(out.select(*named), run, "features")


def second_stage(scored: DataFrame, run: str | None = None) -> DataFrame:
    """Context of the first scores, and support by the query's other best candidates."""
    if (done := finished(scored.sparkSession, run, "context")) is not None:
        return done
    p = F.least(F.greatest("p1", F.lit(1e-6)), F.lit(1 - 1e-6))
    names = {"g_rank_p1": "g_rank", "g_max_p1": "g_max", "g_second_p1": "g_second", "g_diff_p1": "g_diff", "g_sum_p1": "g_sum", "g_cnt50_p1": "g_above_half", "i_rank_p1": "i_rank", "i_max_other_p1": "i_max_other", "i_diff_other_p1": "i_diff_other"}
    ctx = decision.context(scored, "p1").withColumns({"p1_logit": F.ln(p / (1 - p)), **{n: F.col(c) for n, c in names.items()}})
    short = scored.select("q_id", "i_id", F.col("p1").alias("p"))
    for column, s in (("i_n_core", "n"), ("i_a_full", "a")):
        text = features.words(F.substring(column, 1, features.SCORED_CHARS))
        texts = scored.select("i_id", (text if s == "n" else F.when(F.col(column) != "", text)).alias("toks")).dropDuplicates(["i_id"])
        near = features.cluster_support(short, texts, "token_set").select("q_id", "i_id", F.col("c1").alias(f"c2t_{s}1"), F.col("c2").alias(f"c2t_{s}2"), F.col("support").alias(f"support_{s}"))
        ctx = ctx.join(near, ["q_id", "i_id"])
    return kept(ctx, run, "context")


def train(spark: SparkSession, folder: str, out: str, config: Config = Config(), split: str = "train", tables: Tables = DEFAULT, run: str | None = None) -> dict:
    """Fits both stages, calibration and decision; writes models, contract and report below out. A run with a name leaves
    its candidates, features and context in the shared folder and, if started again with equal inputs, goes on from the last."""
    world = prepare(spark, folder, split, tables)
    rows = featurise(world, block(world, config, run), config, run)
    if config.train_countries:
        chosen = world.query.where(F.col("ckey").isin(*config.train_countries)).select("q_id")
        rows = rows.join(chosen, "q_id", "left_semi")
    first = learning.fit_folds(rows, STAGE1, learning.STAGE1, config.rounds, config.depth)
    scored = written(learning.scored(rows, STAGE1, first, "p1"), "stage1")
    context = second_stage(scored, run)
    second = learning.fit_folds(context, STAGE2, learning.STAGE2, config.rounds, config.depth)
    final = written(learning.scored(context, STAGE2, second, "p"), "stage2")
    fold = learning.fold_of()
    calibration = IsotonicRegression(featuresCol="p", labelCol="y").fit(final.where(fold.isin(*learning.STAGE2)).select("p", F.col("y").cast("double").alias("y")))
    for stage, models in (("stage1", first), ("stage2", second)):
        for f, model in models.items():
            model.write().overwrite().save(f"{out}/{stage}/{f}")
    calibration.write().overwrite().save(f"{out}/calibration")
    held = final.where(fold.isin(*learning.HOLDOUT))
    entities = world.query.where(fold.isin(*learning.HOLDOUT)).select("q_id", F.col("ckey").alias("segment"))
    entities = entities.join(world.truth.groupBy("q_id").agg(F.count("*").alias("truth")), "q_id", "left").na.fill({"truth": 0})
    tuned = tune(calibration.transform(final.where(fold.isin(*learning.STAGE2))).withColumn("p", F.col("prediction")), world, fold, config)
    chosen = decide(calibration.transform(held).withColumn("p", F.col("prediction")), config, tuned)
    report = {r["segment"]: r["macro_f05"] for r in metrics.macro_f05(metrics.entity_counts(entities, chosen)).collect()}
    meta = {"contract": config.contract([*STAGE1, *STAGE2]), "folds": [list(first), list(second)], "decision": tuned, "report": report}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/meta")
    return report


def tune(pairs: DataFrame, world: World, fold: Column, config: Config) -> dict:
    """The setting of the grid that scores best on out-of-fold pairs of the second stage's folds."""
    asked = world.query.where(fold.isin(*learning.STAGE2)).select("q_id")
    entities = asked.join(world.truth.groupBy("q_id").agg(F.count("*").alias("truth")), "q_id", "left").na.fill({"truth": 0})
    owned = written(decision.one_owner(adjusted(pairs, config).select("q_id", "i_id", "p", "y")), "owned")
    best = decision.grid_best(owned, entities).first()
    return {k: best[k] for k in ("method", "tau", "gamma", "miss")}


def adjusted(pairs: DataFrame, config: Config) -> DataFrame:
    """Pairs with p moved by house numbers."""
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return pairs.withColumn("p", decision.proximity_adjusted(F.col("p"), number("q_a_first_num"), number("i_a_first_num"), config.housenum_bonus, config.housenum_near))


def decide(pairs: DataFrame, config: Config, tuned: dict | None = None) -> DataFrame:
    """House numbers adjust p; then one owner, then the tuned rule, or the config's."""
    owned, rule = decision.one_owner(adjusted(pairs, config)), tuned or {"method": "expected_f", "tau": config.tau, "gamma": config.gamma, "miss": config.miss}
    if rule["method"] == "threshold":
        return owned.where(F.col("p") >= rule["tau"])
    return decision.expected_f_prefix(owned, rule["tau"], rule["gamma"], rule["miss"])


def predict(spark: SparkSession, folder: str, models: str, out: str, config: Config = Config(), split: str = "test", tables: Tables = DEFAULT) -> DataFrame:
    """Writes matched and candidate lists below out; returns the checks of the matched one."""
    meta = json.loads(spark.read.text(f"{models}/meta").first()["value"])
    config = enforce(meta["contract"], config, [*STAGE1, *STAGE2])
    world = prepare(spark, folder, split, tables)
    rows = featurise(World(world.query, world.index, None, world.vectors), block(world, config), config)
    load = lambda stage, folds: {f: PipelineModel.load(f"{models}/{stage}/{f}") for f in folds}
    context = second_stage(written(learning.scored(rows, STAGE1, load("stage1", meta["folds"][0]), "p1"), "stage1"))
    final = learning.scored(context, STAGE2, load("stage2", meta["folds"][1]), "p")
    scored = written(IsotonicRegressionModel.load(f"{models}/calibration").transform(final).withColumn("p", F.col("prediction")), "scores")
    chosen = decide(scored, config, meta["decision"]).withColumn("id", F.col("i_id"))
    matched = written(lists.ranked_lists(world.query, chosen), "matched")
    offered = written(lists.ranked_lists(world.query, scored.withColumn("id", F.col("i_id"))), "offered")
    split = lambda df: df.select(F.col("q_id").alias("s1"), F.filter(F.split("ids", ","), lambda x: x != "").alias("ids"))
    required, known = world.query.select(F.col("q_id").alias("s1")), world.index.select(F.col("i_id").alias("id"))
    candidates = scored.select(F.col("q_id").alias("s1"), F.col("i_id").alias("id"))
    checks = written(lists.list_checks(split(matched), required, known, candidates).withColumn("list", F.lit("matched")).unionByName(lists.list_checks(split(offered), required, known).withColumn("list", F.lit("candidates"))), "checks")
    if faults := checks.where("n > 0").collect():
        raise ValueError(f"the lists aren't written, as checks fail: {[tuple(f) for f in faults]}")
    lists.write_id_lists(matched, f"{out}/matched", "matched_entity_ids", "pos")
    lists.write_id_lists(offered, f"{out}/candidates", "candidate_entity_ids", "pos")
    return checks
