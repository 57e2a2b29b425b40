"""Metrics, decisions and list checks over scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decision, metrics, sampling
from tessera.plans.fixtures import ENTITIES_SQL, PAIRS_SQL, entities, pairs
from tessera.plans.registry import ORACLE_SQL, query
from tessera.session import table
from tessera.sources import lists

BASE = f"with {PAIRS_SQL}, {ENTITIES_SQL}"
F_SQL = "case when {g} = 0 then (case when {n} = 0 then 1.0 else 0.0 end) when {n} = 0 then 0.0 else 1.25 * {t} / (0.25 * {g} + {n}) end"
COUNTS_SQL = """counts as (
    select e.q_id, e.segment, e.truth, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp
    from entities e left join (select q_id, count(*) as n_pred, sum(y) as tp from pairs where p >= 0.5 group by 1) s on s.q_id = e.q_id
)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.entity_counts(entities(spark, sf), pairs(spark, sf).where("p >= 0.5"))


@query(f"""{BASE}, {COUNTS_SQL}
select coalesce(segment, 'ALL') as segment, count(*) as n_entities, round(avg({F_SQL.format(g='truth', n='n_pred', t='tp')}), 6) as macro_f05
from counts group by rollup(segment)""")
def macro_f05_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_f05(_counts(spark, sf))


@query(f"""{BASE}, {COUNTS_SQL}
select coalesce(segment, 'ALL') as segment, count(*) as n_entities, round(avg({F_SQL.format(g='truth', n='n_pred', t='tp')}), 6) as macro_f05,
    round(avg(case when tp = n_pred and tp = truth then 1.0 else 0.0 end), 6) as perfect_share,
    round(avg(truth), 6) as mean_truth, round(avg(n_pred), 6) as mean_pred,
    cast(sum(tp) as bigint) as tp, cast(sum(n_pred - tp) as bigint) as fp, cast(sum(truth - tp) as bigint) as fn,
    round(sum(tp) / greatest(sum(n_pred), 1), 6) as precision, round(sum(tp) / greatest(sum(truth), 1), 6) as recall,
    round(avg({F_SQL.format(g='truth', n='tp', t='tp')}), 6) as f_without_fp,
    round(avg({F_SQL.format(g='truth', n='(truth + n_pred - tp)', t='truth')}), 6) as f_without_fn,
    round(avg(case when truth = 0 then (case when n_pred = 0 then 1.0 else 0.0 end) end), 6) as singleton_accuracy,
    round(avg(case when truth > 0 then (case when n_pred = 0 then 1.0 else 0.0 end) end), 6) as empty_on_matched
from counts group by rollup(segment)""")
def score_report_headroom(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_report(_counts(spark, sf))


@query(f"""{BASE}, {COUNTS_SQL}
select coalesce(t.n, p.n) as n, coalesce(truth_entities, 0) as truth_entities, coalesce(pred_entities, 0) as pred_entities
from (select truth as n, count(*) as truth_entities from counts group by 1) t
full join (select n_pred as n, count(*) as pred_entities from counts group by 1) p on p.n = t.n""")
def count_histogram_pred_vs_truth(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.count_histogram(_counts(spark, sf))


@query(f"""with {PAIRS_SQL}, named as (
    select q_id, 2 + i_id % 2 as src, 'truth' as kind from pairs where y = 1
    union all select q_id, 2 + i_id % 2, 'predicted' from pairs where p >= 0.5
)
select kind, src, count(*) filter (n > case src when 2 then 2 else 3 end) as violations, max(n) as most
from (select kind, src, q_id, count(*) as n from named group by 1, 2, 3) group by 1, 2""")
def cap_violations(spark: SparkSession, sf: str) -> DataFrame:
    named = pairs(spark, sf).withColumn("src", 2 + F.col("i_id") % 2)
    both = named.where("y = 1").withColumn("kind", F.lit("truth")).unionByName(named.where("p >= 0.5").withColumn("kind", F.lit("predicted")))
    return metrics.cap_violations(both, {2: 2, 3: 3})


@query(f"with {PAIRS_SQL} select i_id, count(distinct q_id) as owners, min(q_id) as first_owner from pairs where y = 1 group by 1 having count(distinct q_id) > 1")
def one_owner_audit(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.claimed_by_several(pairs(spark, sf).where("y = 1"))


@query("""with rows as (
    select 'S1-' || l_orderkey as s1, list(case when l_partkey % 97 = 0 then 'S1-' when l_partkey % 89 = 0 then 'X-' else 'S' || (2 + l_partkey % 2) || '-' end || l_partkey order by l_linenumber, l_partkey) as ids
    from lineitem group by l_orderkey
), ids as (select s1, unnest(ids) as id from rows),
known as (select distinct 'S' || (2 + p_partkey % 2) || '-' || p_partkey as id from part),
required as (select 'S1-' || o_orderkey as s1 from orders),
cand as (select distinct 'S1-' || l_orderkey as s1, 'S' || (2 + l_partkey % 2) || '-' || l_partkey as id from lineitem where l_quantity > 5)
select 'repeated_row' as "check", count(*) as n from (select s1 from rows group by 1 having count(*) > 1)
union all select 'repeated_id', count(*) from rows where len(ids) <> len(list_distinct(ids))
union all select 'self_match', count(*) from rows where len(list_filter(ids, lambda x: starts_with(x, 'S1-'))) > 0
union all select 'wrong_prefix', count(*) from rows where len(list_filter(ids, lambda x: not regexp_matches(x, '^S[123]-'))) > 0
union all select 'unknown_id', count(*) from (select distinct id from ids) where id not in (select id from known)
union all select 'missing_entity', count(*) from required where s1 not in (select s1 from rows)
union all select 'surplus_entity', count(*) from rows where s1 not in (select s1 from required)
union all select 'not_candidate', count(distinct s1) from ids where (s1, id) not in (select (s1, id) from cand)""")
def list_file_validation(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    good = F.concat(F.lit("S"), 2 + F.col("l_partkey") % 2, F.lit("-"), F.col("l_partkey"))
    bad = F.when(F.col("l_partkey") % 97 == 0, F.concat(F.lit("S1-"), F.col("l_partkey"))).when(F.col("l_partkey") % 89 == 0, F.concat(F.lit("X-"), F.col("l_partkey"))).otherwise(good)
    s1 = F.concat(F.lit("S1-"), F.col("l_orderkey"))
    rows = line.groupBy(s1.alias("s1")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", bad.alias("id")))), lambda x: x["id"]).alias("ids"))
    known = table(spark, sf, "part").select(F.concat(F.lit("S"), 2 + F.col("p_partkey") % 2, F.lit("-"), F.col("p_partkey")).alias("id"))
    required = table(spark, sf, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey")).alias("s1"))
    return lists.list_checks(rows, required, known, line.where("l_quantity > 5").select(s1.alias("s1"), good.alias("id")).distinct())


OWNED_SQL = f"""with {PAIRS_SQL}, {ENTITIES_SQL}, owned as (
    select q_id, i_id, p, y from (select *, row_number() over (partition by i_id order by p desc, q_id) as o from pairs) where o = 1
)"""


@query(f"{OWNED_SQL} select * from owned")
def one_owner_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return decision.one_owner(pairs(spark, sf))


@query(f"""with {PAIRS_SQL}
select q_id, i_id, round(case when gap = 0 then least(p + 0.05, 1.0) when gap <= 5 then greatest(p - 0.05, 0.0) else p end, 6) as p
from (select *, abs(q_id % 100 - (i_id // 1000) % 100) as gap from pairs)""")
def numeric_proximity_adjust(spark: SparkSession, sf: str) -> DataFrame:
    moved = decision.proximity_adjusted(F.col("p"), F.col("q_id") % 100, F.expr("(i_id div 1000) % 100"))
    return pairs(spark, sf).select("q_id", "i_id", F.round(moved, 6).alias("p"))


PREFIX_SQL = """ranked as (
    select *, row_number() over w as rk, sum(p) over (w rows unbounded preceding) as cum, sum(p) over (partition by {g}q_id) as total,
        round({gamma} * exp(sum(ln(1 - least(p, 1 - 1e-7))) over (partition by {g}q_id)), 9) as ef_empty
    from {source} window w as (partition by {g}q_id order by p desc, i_id)
), valued as (
    select *, case when p < {tau} then -1.0 else round(1.25 * cum / (0.25 * (total + {miss}) + rk), 9) end as ef from ranked
), cut as (
    select *, max(ef) over (partition by {g}q_id) as best from valued
), chosen as (
    select * from (select *, min(case when ef = best then rk end) over (partition by {g}q_id) as last from cut) where best > ef_empty and best > 0 and rk <= last
)"""


@query(f"{OWNED_SQL}, {PREFIX_SQL.format(g='', source='owned', tau=0.3, gamma=0.85, miss=0.1)} select q_id, i_id, p, y, cast(rk as integer) as rk from chosen")
def expected_f_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return decision.expected_f_prefix(decision.one_owner(pairs(spark, sf)))


_list = lambda values: f"unnest([{', '.join(map(str, values))}]::double[])"
SWEPT_SQL = f"""grid as (select {_list(decision.THRESHOLDS)} as tau),
counts as (
    select tau, e.q_id, e.truth, count(i_id) as n, coalesce(sum(y), 0) as tp
    from grid cross join entities e left join {{source}} s on s.q_id = e.q_id and p >= tau group by 1, 2, 3
), swept as (
    select tau, round(avg({F_SQL.format(g='truth', n='n', t='tp')}), 6) as macro_f05, cast(sum(n) as bigint) as n_selected from counts group by 1
)"""


@query(f"{BASE}, {SWEPT_SQL.format(source='pairs')} select * from swept")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return decision.threshold_sweep(pairs(spark, sf), entities(spark, sf), decision.THRESHOLDS)


@query(f"""{OWNED_SQL}, {SWEPT_SQL.format(source='owned')}, ranked as (
    select o.q_id, p, truth, row_number() over w as rk, sum(p) over (w rows unbounded preceding) as cum, sum(y) over (w rows unbounded preceding) as tp,
        sum(p) over (partition by o.q_id) as total, exp(sum(ln(1 - least(p, 1 - 1e-7))) over (partition by o.q_id)) as none_
    from owned o join entities e on e.q_id = o.q_id window w as (partition by o.q_id order by p desc, i_id)
), taus as (select {_list(decision.TAUS)} as tau), gammas as (select {_list(decision.GAMMAS)} as gamma), misses as (select {_list(decision.MISSES)} as miss),
best as (
    select q_id, tau, miss, any_value(truth) as truth, any_value(none_) as none_, max(struct_pack(ef := round(1.25 * cum / (0.25 * (total + miss) + rk), 9), k := -rk, tp := tp)) as b
    from ranked cross join taus cross join misses where p >= tau group by 1, 2, 3
), gains as (
    select tau, gamma, miss, sum(case when b.ef > round(gamma * none_, 9) and b.ef > 0 then {F_SQL.format(g='truth', n='(-b.k)', t='b.tp')} - (case when truth = 0 then 1.0 else 0.0 end) else 0.0 end) as gain
    from best cross join gammas group by 1, 2, 3
), expected as (
    select t.tau, g.gamma, m.miss, round(((select sum(case when truth = 0 then 1.0 else 0.0 end) from entities) + coalesce(gain, 0.0)) / (select count(*) from entities), 6) as macro_f05
    from taus t cross join gammas g cross join misses m left join gains x on x.tau = t.tau and x.gamma = g.gamma and x.miss = m.miss
), points as (
    select row_number() over (order by tau) - 1 as point, 'threshold' as method, tau, null::double as gamma, null::double as miss, macro_f05 from swept
    union all select {len(decision.THRESHOLDS)} + row_number() over (order by tau, gamma, miss) - 1, 'expected_f', tau, gamma, miss, macro_f05 from expected
)
select * from points""")
def decision_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All 325 settings."""
    return decision.grid_scores(decision.one_owner(pairs(spark, sf)), entities(spark, sf))


@query(f"{ORACLE_SQL['decision_grid']} order by macro_f05 desc, point limit 1")
def decision_grid_best(spark: SparkSession, sf: str) -> DataFrame:
    return decision.grid_best(decision.one_owner(pairs(spark, sf)), entities(spark, sf))


@query(f"""{BASE}, cum as (
    select q_id, row_number() over w as k, sum(y) over (w rows unbounded preceding) as tp from pairs window w as (partition by q_id order by p desc, i_id)
), best as (
    select c.q_id, max({F_SQL.format(g='truth', n='k', t='tp')}) as f from cum c join entities e on e.q_id = c.q_id group by 1
), scored as (
    select e.q_id, segment, greatest(coalesce(f, 0.0), case when truth = 0 then 1.0 else 0.0 end) as f from entities e left join best b on b.q_id = e.q_id
)
select coalesce(segment, 'ALL') as segment, count(*) as n_entities, round(avg(f), 6) as oracle_f05 from scored group by rollup(segment)""")
def oracle_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_segment(decision.oracle_prefix(pairs(spark, sf), entities(spark, sf)), F.count("*").alias("n_entities"), F.round(F.avg("f"), 6).alias("oracle_f05"))


@query(f"""{OWNED_SQL}, lists as (
    select q_id, string_agg('S' || (2 + i_id % 2) || '-' || i_id, ',' order by p desc, 'S' || (2 + i_id % 2) || '-' || i_id) as ids from owned where p >= 0.5 group by 1
) select e.q_id, coalesce(ids, '') as ids from entities e left join lists l on l.q_id = e.q_id""")
def ranked_id_lists(spark: SparkSession, sf: str) -> DataFrame:
    owned = decision.one_owner(pairs(spark, sf)).where("p >= 0.5")
    named = owned.withColumn("id", F.concat(F.lit("S"), 2 + F.col("i_id") % 2, F.lit("-"), F.col("i_id")))
    return lists.ranked_lists(entities(spark, sf), named)


@query(f"""with {PAIRS_SQL}, r as (
    select *, row_number() over (partition by q_id order by p desc, i_id) as g_rank, row_number() over (partition by i_id order by p desc, q_id) as i_rank from pairs
)
select q_id, i_id, cast(g_rank as integer) as g_rank, round(max(p) over (partition by q_id), 6) as g_max, round(p - max(p) over (partition by q_id), 6) as g_diff,
    count(*) over (partition by q_id) as q_ncand, count(*) over (partition by i_id) as i_ncand
from r""")
def group_context_features(spark: SparkSession, sf: str) -> DataFrame:
    out = decision.context(pairs(spark, sf))
    return out.select("q_id", "i_id", "g_rank", F.round("g_max", 6).alias("g_max"), F.round("g_diff", 6).alias("g_diff"), "q_ncand", "i_ncand")


@query(f"""with {PAIRS_SQL}, r as (
    select *, row_number() over (partition by q_id order by p desc, i_id) as g_rank, row_number() over (partition by i_id order by p desc, q_id) as i_rank from pairs
), s as (
    select *, max(case when g_rank = 2 then p end) over (partition by q_id) as g_second, sum(p) over (partition by q_id) as g_sum,
        sum(case when p > 0.5 then 1 else 0 end) over (partition by q_id) as g_above_half,
        case when i_rank = 1 then max(case when i_rank = 2 then p end) over (partition by i_id) else max(p) over (partition by i_id) end as i_max_other
    from r
)
select q_id, i_id, cast(i_rank as integer) as i_rank, round(g_second, 6) as g_second, round(g_sum, 6) as g_sum, cast(g_above_half as bigint) as g_above_half,
    round(i_max_other, 6) as i_max_other, round(p - coalesce(i_max_other, 0), 6) as i_diff_other from s""")
def owner_competition(spark: SparkSession, sf: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return decision.context(pairs(spark, sf)).select("q_id", "i_id", "i_rank", r6("g_second"), r6("g_sum"), "g_above_half", r6("i_max_other"), r6("i_diff_other"))


@query(f"""with {PAIRS_SQL}, n as (select q_id, i_id, p, y from pairs where y = 0 order by p desc, q_id, i_id limit 5000)
select q_id, i_id, p, y from pairs where y = 1 union all select * from n""")
def hard_negative_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hard_negatives(pairs(spark, sf), F.col("p"), 5000)


@query(f"""{BASE} select segment, count(*) as n_pairs, round(avg(y), 6) as positive_rate, round(avg(p), 6) as mean_p, round(avg(case when y = 1 then p end), 6) as mean_p_positive
from pairs join entities on entities.q_id = pairs.q_id group by 1""")
def segment_calibration(spark: SparkSession, sf: str) -> DataFrame:
    joined = pairs(spark, sf).join(entities(spark, sf), "q_id")
    return joined.groupBy("segment").agg(F.count("*").alias("n_pairs"), F.round(F.avg("y"), 6).alias("positive_rate"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.when(F.col("y") == 1, F.col("p"))), 6).alias("mean_p_positive"))


@query(f"""{OWNED_SQL}, truth as (select q_id, i_id from pairs where y = 1), picked as (select q_id, i_id from owned where p >= 0.5),
cand as (select distinct l_orderkey as q_id, l_partkey * 1000 + l_suppkey % 10 as i_id from lineitem where l_quantity > 5), items as (
    select q_id, i_id, case when (q_id, i_id) in (select (q_id, i_id) from cand) then 'missed_in_candidates' else 'blocking_miss' end as class
    from truth where (q_id, i_id) not in (select (q_id, i_id) from picked)
    union all select q_id, i_id, case when q_id not in (select q_id from truth) then 'fp_on_singleton' when i_id in (select i_id from truth) then 'fp_stolen' else 'fp_distractor' end
    from picked where (q_id, i_id) not in (select (q_id, i_id) from truth)
), named as (
    select i.*, segment from items i join entities e on e.q_id = i.q_id union all select *, 'ALL' from items
), counted as (select segment, class, count(*) as n, min(struct_pack(q := q_id, i := i_id)) as e from named group by 1, 2)
select segment, class, n, round(n / sum(n) over (partition by segment), 6) as share, e.q as example_q, e.i as example_i from counted""")
def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of over five pieces were candidates."""
    all_pairs = pairs(spark, sf)
    picked = decision.one_owner(all_pairs).where("p >= 0.5").select("q_id", "i_id")
    offered = table(spark, sf, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("q_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 10).alias("i_id"))
    items = metrics.error_items(all_pairs.where("y = 1").select("q_id", "i_id"), picked, offered)
    return metrics.error_taxonomy(items, entities(spark, sf))


TRAITS = {"urgent": "o_orderpriority = '1-URGENT'", "open_order": "o_orderstatus = 'O'", "large_part": "p_size >= 25", "dear_part": "p_retailprice >= 1000"}


@query(f"""with {PAIRS_SQL}, t as (
    select p >= 0.5 as hit, {', '.join(f'cast({c} as int) as {n}' for n, c in TRAITS.items())}
    from pairs join orders on o_orderkey = q_id join part on p_partkey = i_id // 1000 where y = 1
), r as ({' union all '.join(f"select '{n}' as trait, avg(case when not hit then {n} end) as missed, avg(case when hit then {n} end) as found from t" for n in TRAITS)})
select trait, round(missed, 6) as missed, round(found, 6) as found, round(missed / greatest(found, 1e-6), 6) as lift from r""")
def miss_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Traits of the true pairs that were missed, against those found."""
    true = pairs(spark, sf).where("y = 1").select((F.col("p") >= 0.5).alias("hit"), F.col("q_id").alias("o_orderkey"), F.expr("i_id div 1000").alias("p_partkey"))
    named = true.join(table(spark, sf, "orders"), "o_orderkey").join(table(spark, sf, "part"), "p_partkey")
    return metrics.trait_lift(named, "hit", {n: F.expr(c) for n, c in TRAITS.items()})


@query()
def crc_fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """SQL here has no CRC; tests hold the folds against zlib."""
    docs = table(spark, sf, "documents").select(sampling.crc_fold(F.col("doc_id").cast("string"), 10, "fold").alias("fold"))
    return docs.groupBy("fold").agg(F.count("*").alias("n"))


@query()
def dev_subworld(spark: SparkSession, sf: str) -> DataFrame:
    """As crc_fold_counts."""
    p = pairs(spark, sf)
    owners = decision.one_owner(p.where("y = 1")).select("i_id", "q_id")
    kept, index = sampling.sub_world(entities(spark, sf).select("q_id"), p.select("i_id").distinct(), owners, 0.3)
    return kept.select(F.lit("query").alias("side"), F.col("q_id").alias("id")).unionByName(index.select(F.lit("index").alias("side"), F.col("i_id").alias("id")))
