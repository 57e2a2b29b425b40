"""Choosing matches: one owner for each index record, expected-F prefixes, thresholds and grids.

Ties go to the lower id. Sums are rounded to 9 digits before they are compared, so that the last bits, which
hang on the order of addition, can't flip a rank.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import f_half


def one_owner(pairs: DataFrame) -> DataFrame:
    """Of the pairs of an index record the one with the highest p, of equal ones the lowest q_id."""
    w = Window.partitionBy("i_id").orderBy(F.desc("p"), "q_id")
    return pairs.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def proximity_adjusted(p: Column, a: Column, b: Column, bonus: float = 0.05, near: int = 5) -> Column:
    """Adds the bonus where two numbers are equal, takes it off where they differ by at most near; within 0 to 1."""
    gap = F.abs(a - b)
    moved = F.when(gap == 0, p + bonus).when(gap <= near, p - bonus).otherwise(p)
    return F.coalesce(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), p)


def expected_f_prefix(pairs: DataFrame, tau: float | Column = 0.3, gamma: float | Column = 0.85, miss: float | Column = 0.1, grid: tuple[str, ...] = ()) -> DataFrame:
    """The prefix of each entity's candidates, by falling p, whose expected F0.5 is the highest; none where an
    empty list is expected to score as well. ef_k = 1.25 * cum / (0.25 (total + miss) + k) while p >= tau."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    entity = Window.partitionBy(*grid, "q_id")
    ranked = entity.orderBy(F.desc("p"), "i_id")
    clipped = F.least(F.col("p"), F.lit(1 - 1e-7))
    out = pairs.withColumn("rk", F.row_number().over(ranked)).withColumn("cum", F.sum("p").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("total", F.sum("p").over(entity)).withColumn("ef_empty", F.round(col(gamma) * F.exp(F.sum(F.log1p(-clipped)).over(entity)), 9))
    ef = F.round(1.25 * F.col("cum") / (0.25 * (F.col("total") + col(miss)) + F.col("rk")), 9)
    out = out.withColumn("ef", F.when(F.col("p") < col(tau), F.lit(-1.0)).otherwise(ef)).withColumn("best", F.max("ef").over(entity))
    out = out.withColumn("cut", F.min(F.when(F.col("ef") == F.col("best"), F.col("rk"))).over(entity))
    return out.where((F.col("best") > F.col("ef_empty")) & (F.col("best") > 0) & (F.col("rk") <= F.col("cut"))).select(*grid, *pairs.drop(*grid).columns, "rk")


def threshold_sweep(pairs: DataFrame, entities: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, macro_f05, n_selected) of all thresholds in one pass: each pair adds to its entity's F0.5, and the gain counts
    for the thresholds at or below its p, so gains are summed between neighbouring thresholds and then from the top."""
    taus = sorted(taus)
    gains = _gains(pairs, entities).withColumn("below", F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: t <= F.col("p"))))
    steps = gains.groupBy("below").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    base = entities.agg(F.sum(_empty()).alias("base"), F.count("*").alias("entities"))
    table = steps.agg(F.collect_list(F.struct("below", "gain", "n")).alias("steps")).join(F.broadcast(base))
    rows = table.select("*", F.posexplode(F.array(*map(F.lit, taus))).alias("k", "tau"))
    reached = F.filter("steps", lambda x: x["below"] > F.col("k"))
    total = lambda c, zero: F.aggregate(reached, zero, lambda s, x: s + x[c])
    return rows.select("tau", F.round((F.col("base") + total("gain", F.lit(0.0))) / F.col("entities"), 6).alias("macro_f05"), total("n", F.lit(0).cast("long")).alias("n_selected"))


def _empty() -> Column:
    """F0.5 of an empty prediction."""
    return f_half(F.lit(0), F.lit(0), F.col("truth"))


def _gains(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with what each adds to its entity's F0.5 when the entity's pairs come by falling p."""
    ranked = Window.partitionBy("q_id").orderBy(F.desc("p"), "i_id")
    named = pairs.join(entities.select("q_id", "truth"), "q_id")
    cum = named.withColumn("k", F.row_number().over(ranked)).withColumn("tp", F.sum("y").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.when(F.col("k") == 1, _empty()).otherwise(f_half(F.col("tp") - F.col("y"), F.col("k") - 1, F.col("truth")))
    return cum.withColumn("gain", f_half(F.col("tp"), F.col("k"), F.col("truth")) - before)


#: The grid of settings, fixed values: thresholds, then (tau, gamma, miss) of the expected-F rule.
THRESHOLDS = [round(0.05 + 0.025 * k, 3) for k in range(37)]
TAUS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
GAMMAS = (0.6, 0.7, 0.85, 1.0, 1.1, 1.2, 1.35, 1.5, 1.7)
MISSES = (0.0, 0.1, 0.2, 0.3)


def grid_scores(pairs: DataFrame, entities: DataFrame, thresholds: list[float] = THRESHOLDS, taus: tuple[float, ...] = TAUS, gammas: tuple[float, ...] = GAMMAS, misses: tuple[float, ...] = MISSES) -> DataFrame:
    """(point, method, tau, gamma, miss, macro_f05) of every setting: thresholds, then expected_f by tau, gamma, miss.

    Pairs are ranked within their entity once. For each (tau, miss) the entity's best prefix is a maximum over its pairs,
    whatever gamma is; the few numbers an entity then has are scored for all settings in one Arrow kernel that
    sends sums only."""
    entity = Window.partitionBy("q_id")
    ranked = entity.orderBy(F.desc("p"), "i_id")
    clipped = F.least(F.col("p"), F.lit(1 - 1e-7))
    named = pairs.join(entities.select("q_id", "truth"), "q_id")
    out = named.withColumn("rk", F.row_number().over(ranked)).withColumns({"cum": F.sum("p").over(ranked.rowsBetween(Window.unboundedPreceding, 0)), "tp": F.sum("y").over(ranked.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumn("total", F.sum("p").over(entity))
    value = lambda miss: F.round(1.25 * F.col("cum") / (0.25 * (F.col("total") + miss) + F.col("rk")), 9)
    best = [F.max(F.when(F.col("p") >= t, F.struct(value(m).alias("ef"), (-F.col("rk")).alias("k"), F.col("tp")))).alias(f"b{x}_{y}") for x, t in enumerate(taus) for y, m in enumerate(misses)]
    rows = out.groupBy("q_id").agg(F.first("truth").alias("truth"), F.exp(F.sum(F.log1p(-clipped))).alias("none"), *best)
    names = [f"b{x}_{y}" for x in range(len(taus)) for y in range(len(misses))]
    part = lambda field, kind, default: F.array(*(F.coalesce(F.col(f"{n}.{field}").cast(kind), F.lit(default)) for n in names))
    rows = rows.select("truth", "none", part("ef", "double", -1.0).alias("ef"), part("k", "double", 0.0).alias("k"), part("tp", "double", 0.0).alias("tp"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(taus), len(gammas), len(misses)))
        for batch in batches:
            truth, none = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
            ef, k, tp = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(truth), len(taus), len(misses)) for c in (2, 3, 4))
            g = truth[:, None, None]
            gain = np.where(g > 0, 1.25 * tp / np.maximum(0.25 * g - k, 0.25), -1.0)  # an empty truth scored 1 before
            for x, gamma in enumerate(gammas):
                take = (ef > np.round(gamma * none, 9)[:, None, None]) & (ef > 0)
                sums[:, x] += np.where(take, gain, 0.0).sum(axis=0)
        at = np.indices(sums.shape).reshape(3, -1)
        yield pa.record_batch([pa.array(at[0] * len(gammas) * len(misses) + at[1] * len(misses) + at[2]), pa.array(sums.ravel())], ["point", "gain"])

    base = entities.agg(F.coalesce(F.sum(_empty()), F.lit(0.0)).alias("base"), F.count("*").alias("n"))
    sums = rows.mapInArrow(kernel, "point long, gain double").groupBy("point").agg(F.sum("gain").alias("gain"))
    points = pairs.sparkSession.createDataFrame([(k, t, g, m) for k, (t, g, m) in enumerate(itertools.product(taus, gammas, misses))], "point long, tau double, gamma double, miss double")
    scored = points.join(sums, "point", "left").na.fill(0.0, ["gain"]).join(F.broadcast(base))
    expected = scored.select((F.col("point") + len(thresholds)).alias("point"), F.lit("expected_f").alias("method"), "tau", "gamma", "miss", F.round((F.col("base") + F.col("gain")) / F.col("n"), 6).alias("macro_f05"))
    swept = threshold_sweep(pairs, entities, thresholds).select(F.array_position(F.array(*map(F.lit, thresholds)), F.col("tau")).alias("point"), F.lit("threshold").alias("method"), "tau", F.lit(None).cast("double").alias("gamma"), F.lit(None).cast("double").alias("miss"), "macro_f05")
    return swept.withColumn("point", F.col("point") - 1).unionByName(expected)


def grid_best(pairs: DataFrame, entities: DataFrame, **grid) -> DataFrame:
    """The setting of the highest macro F0.5, of equals the first of the grid."""
    return grid_scores(pairs, entities, **grid).orderBy(F.desc("macro_f05"), "point").limit(1)


def oracle_prefix(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """For each entity the best F0.5 of any prefix of its candidates, the empty one too."""
    ranked = Window.partitionBy("q_id").orderBy(F.desc("p"), "i_id")
    cum = pairs.withColumn("k", F.row_number().over(ranked)).withColumn("tp", F.sum("y").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    best = cum.join(entities, "q_id").groupBy("q_id").agg(F.max(f_half(F.col("tp"), F.col("k"), F.col("truth"))).alias("f"))
    return entities.join(best, "q_id", "left").select("q_id", "segment", F.greatest(F.coalesce("f", F.lit(0.0)), f_half(F.lit(0), F.lit(0), F.col("truth"))).alias("f"))


def context(pairs: DataFrame, score: str = "p") -> DataFrame:
    """Rank, best, second best and gaps of a score within the query and within the index record."""
    q, i = Window.partitionBy("q_id"), Window.partitionBy("i_id")
    qr, ir = q.orderBy(F.col(score).desc_nulls_last(), "i_id"), i.orderBy(F.col(score).desc_nulls_last(), "q_id")
    s = F.col(score)
    out = pairs.withColumn("g_rank", F.row_number().over(qr)).withColumn("i_rank", F.row_number().over(ir))
    out = out.withColumns({
        "g_max": F.max(s).over(q),
        "g_second": F.max(F.when(F.col("g_rank") == 2, s)).over(q),
        "g_sum": F.sum(s).over(q),
        "g_above_half": F.sum((s > 0.5).cast("int")).over(q),
        "q_ncand": F.count("*").over(q),
        "i_ncand": F.count("*").over(i),
        "_best": F.max(s).over(i),
        "_second": F.max(F.when(F.col("i_rank") == 2, s)).over(i),
    })
    out = out.withColumn("i_max_other", F.when(F.col("i_rank") == 1, F.col("_second")).otherwise(F.col("_best")))
    return out.withColumn("g_diff", s - F.col("g_max")).withColumn("i_diff_other", s - F.coalesce("i_max_other", F.lit(0.0))).drop("_best", "_second")
