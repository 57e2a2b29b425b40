"""Macro F0.5 and the reports around it.

Entities stay in every average, also those without candidates. An empty prediction for an empty truth scores 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_half(tp: Column, predicted: Column, truth: Column) -> Column:
    """1.25 TP / (0.25 G + P); 1 or 0 where the truth is empty."""
    return F.when(truth == 0, (predicted == 0).cast("double")).when(predicted == 0, F.lit(0.0)).otherwise(1.25 * tp / (0.25 * truth + predicted))


def entity_counts(entities: DataFrame, selected: DataFrame) -> DataFrame:
    """entities (q_id, truth, segment) with n_pred and tp of the selected pairs (q_id, y)."""
    counts = selected.groupBy("q_id").agg(F.count("*").alias("n_pred"), F.sum("y").alias("tp"))
    return entities.join(counts, "q_id", "left").na.fill({"n_pred": 0, "tp": 0})


def by_segment(scored: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates for each segment and, as segment ALL, for all."""
    rolled = scored.rollup("segment").agg(F.grouping("segment").alias("_all"), *aggregates)
    return rolled.withColumn("segment", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("segment"))).drop("_all")


def macro_f05(counts: DataFrame) -> DataFrame:
    scored = counts.withColumn("f", f_half(F.col("tp"), F.col("n_pred"), F.col("truth")))
    return by_segment(scored, F.count("*").alias("n_entities"), F.round(F.avg("f"), 6).alias("macro_f05"))


def score_report(counts: DataFrame) -> DataFrame:
    tp, n, g = F.col("tp"), F.col("n_pred"), F.col("truth")
    share = lambda hit: F.round(F.avg(hit.cast("double")), 6)
    return by_segment(
        counts,
        F.count("*").alias("n_entities"),
        F.round(F.avg(f_half(tp, n, g)), 6).alias("macro_f05"),
        share((tp == n) & (tp == g)).alias("perfect_share"),
        F.round(F.avg(g), 6).alias("mean_truth"),
        F.round(F.avg(n), 6).alias("mean_pred"),
        F.sum(tp).alias("tp"),
        F.sum(n - tp).alias("fp"),
        F.sum(g - tp).alias("fn"),
        F.round(F.sum(tp) / F.greatest(F.sum(n), F.lit(1)), 6).alias("precision"),
        F.round(F.sum(tp) / F.greatest(F.sum(g), F.lit(1)), 6).alias("recall"),
        F.round(F.avg(f_half(tp, tp, g)), 6).alias("f_without_fp"),
        F.round(F.avg(f_half(g, g + n - tp, g)), 6).alias("f_without_fn"),
        F.round(F.avg(F.when(g == 0, (n == 0).cast("double"))), 6).alias("singleton_accuracy"),
        F.round(F.avg(F.when(g > 0, (n == 0).cast("double"))), 6).alias("empty_on_matched"),
    )


def oracle_f(truth_found: Column, truth: Column) -> Column:
    """The best F0.5 that a subset of the candidates can reach."""
    return f_half(truth_found, truth_found, truth)


def count_histogram(counts: DataFrame) -> DataFrame:
    """How many entities have n matches in truth and in the prediction."""
    truth = counts.groupBy(F.col("truth").alias("n")).agg(F.count("*").alias("truth_entities"))
    pred = counts.groupBy(F.col("n_pred").alias("n")).agg(F.count("*").alias("pred_entities"))
    return truth.join(pred, "n", "full").na.fill(0, ["truth_entities", "pred_entities"])


def cap_violations(pairs: DataFrame, caps: dict[int, int]) -> DataFrame:
    """For each source, the entities with more pairs (q_id, src, kind) than its cap."""
    sizes = pairs.groupBy("kind", "src", "q_id").agg(F.count("*").alias("n"))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("src")]
    return sizes.groupBy("kind", "src").agg(F.count_if(F.col("n") > cap).alias("violations"), F.max("n").alias("most"))


def claimed_by_several(pairs: DataFrame) -> DataFrame:
    """Index records that over one entity claims."""
    return pairs.groupBy("i_id").agg(F.countDistinct("q_id").alias("owners"), F.min("q_id").alias("first_owner")).where("owners > 1")


def blocking_report(truth: DataFrame, candidates: DataFrame, n_query: DataFrame, n_index: int) -> DataFrame:
    """Pair recall, best reachable F0.5, candidates per entity and reduction ratio."""
    found = truth.join(candidates.select("q_id", "i_id").distinct(), ["q_id", "i_id"], "left_semi").groupBy("q_id").agg(F.count("*").alias("found"))
    per = n_query.join(truth.groupBy("q_id").agg(F.count("*").alias("truth")), "q_id", "left").join(found, "q_id", "left")
    per = per.join(candidates.groupBy("q_id").agg(F.count("*").alias("cands")), "q_id", "left").na.fill(0)
    return per.agg(
        F.count("*").alias("n_queries"),
        F.sum("truth").alias("n_truth"),
        F.sum("found").alias("n_found"),
        F.round(F.sum("found") / F.greatest(F.sum("truth"), F.lit(1)), 6).alias("recall"),
        F.round(F.avg(oracle_f(F.col("found"), F.col("truth"))), 6).alias("oracle_f05"),
        F.round(F.avg("cands"), 6).alias("cands_per_query"),
        F.count_if(F.col("found") < F.col("truth")).alias("missing_some"),
        F.count_if(F.col("cands") == 0).alias("no_candidates"),
        F.round(1 - F.sum("cands") / (F.count("*") * F.lit(max(1, n_index))), 6).alias("reduction_ratio"),
    )


def trait_lift(rows: DataFrame, hit: str, traits: dict[str, Column]) -> DataFrame:
    """(trait, missed, found, lift): each trait's share among the rows that missed and that hit, and their ratio."""
    share = lambda c, h: F.avg(F.when(F.col(hit) == h, c.cast("int")))
    one = rows.agg(F.array(*(F.struct(F.lit(n).alias("trait"), share(c, False).alias("missed"), share(c, True).alias("found")) for n, c in traits.items())).alias("r"))
    out = one.select(F.explode("r").alias("r")).select("r.*")
    return out.select("trait", F.round("missed", 6).alias("missed"), F.round("found", 6).alias("found"), F.round(F.col("missed") / F.greatest("found", F.lit(1e-6)), 6).alias("lift"))


def tag_rates(tags: DataFrame, rows: DataFrame, group: str, key: str) -> DataFrame:
    """(tag, group, n, rate, example) by group and, as ALL, for all. tags: (key, group, tag); rows: (key, group)."""
    all_of = lambda df: df.withColumn("g", F.explode(F.array(F.lit("ALL"), F.col(group).cast("string"))))
    sizes = all_of(rows.select(group)).groupBy("g").agg(F.count("*").alias("rows"))
    counts = all_of(tags).groupBy("tag", "g").agg(F.count("*").alias("n"), F.min(key).alias("example"))
    return counts.join(sizes, "g").select("tag", F.col("g").alias(group), "n", F.round(F.col("n") / F.col("rows"), 6).alias("rate"), "example")


def error_items(truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q_id, i_id, class) of every wrong pair, all inputs (q_id, i_id): true pairs that aren't predicted are a
    blocking_miss where they weren't candidates, else missed_in_candidates; predicted pairs that aren't true are an
    fp_on_singleton where the entity has no match, fp_stolen where the record belongs to another, else fp_distractor."""
    pair = ["q_id", "i_id"]
    offered = candidates.select(*pair).distinct().withColumn("_in", F.lit(True))
    missed = truth.join(predicted, pair, "left_anti").join(offered, pair, "left").select(*pair, F.when(F.col("_in"), "missed_in_candidates").otherwise("blocking_miss").alias("class"))
    wrong = predicted.join(truth, pair, "left_anti")
    wrong = wrong.join(truth.select("q_id").distinct().withColumn("_some", F.lit(True)), "q_id", "left").join(truth.select("i_id").distinct().withColumn("_owned", F.lit(True)), "i_id", "left")
    kind = F.when(F.col("_some").isNull(), "fp_on_singleton").when(F.col("_owned"), "fp_stolen").otherwise("fp_distractor")
    return missed.unionByName(wrong.select(*pair, kind.alias("class")))


def error_taxonomy(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(segment, class, n, share, example) by segment and, as ALL, for all. entities: (q_id, segment)."""
    named = items.join(entities.select("q_id", "segment"), "q_id").withColumn("segment", F.explode(F.array(F.lit("ALL"), F.col("segment"))))
    counts = named.groupBy("segment", "class").agg(F.count("*").alias("n"), F.min(F.struct("q_id", "i_id")).alias("_e"))
    total = counts.groupBy("segment").agg(F.sum("n").alias("_all"))
    return counts.join(total, "segment").select("segment", "class", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"), F.col("_e.q_id").alias("example_q"), F.col("_e.i_id").alias("example_i"))
