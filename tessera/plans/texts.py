"""Text functions and pair similarities over documents and addresses of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import similarity as sim
from tessera.functions import text as T
from tessera.operators import features, metrics, tokens
from tessera.plans.fixtures import RECORDS_SQL, records
from tessera.plans.registry import query
from tessera.plans.skeleton_sql import SKELETON_SQL
from tessera.session import table

@query(f"""with {RECORDS_SQL}, toks as (select distinct unnest(toks) as tok from records), {SKELETON_SQL} select tok, skeleton from skeletons""")
def consonant_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    toks = records(spark, sf).select(F.explode("toks").alias("tok")).distinct()
    return toks.select("tok", T.skeleton(F.col("tok")).alias("skeleton"))


@query(f"""select page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:www\\.)?([^/:?#]+)', 1), '(\\.(?:{'|'.join(T.TLDS)}))+$', '') as name from pages""")
def domain_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.unwrapped_domain(F.col("url")).alias("name"))


_LEGAL_SQL = ", ".join(f"'{w}'" for w in T.LEGAL)


@query(f"""with {RECORDS_SQL}, c as (select rec_id, toks, list_filter(toks, lambda w: w not in ({_LEGAL_SQL})) as rest from records)
select rec_id, array_to_string(case when len(rest) > 0 then rest else toks end, ' ') as core from c""")
def legal_suffix_core(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("rec_id", F.array_join(T.legal_free(F.col("toks")), " ").alias("core"))


@query(f"""with {RECORDS_SQL}, d as (select rec_id, unnest(toks) as t, generate_subscripts(toks, 1) as pos from records),
f as (select rec_id, cast(t as bigint) as n, min(pos) as pos from d where regexp_matches(t, '^[0-9]{{1,12}}$') group by 1, 2),
r as (select *, row_number() over (partition by rec_id order by pos) as k from f)
select records.rec_id, coalesce(string_agg(cast(n as varchar), ' ' order by pos) filter (k <= 6), '') as nums, min(n) filter (k = 1) as first_num
from records left join r on r.rec_id = records.rec_id group by 1""")
def address_numbers(spark: SparkSession, sf: str) -> DataFrame:
    nums = T.numbers(F.col("toks"))
    return records(spark, sf).select("rec_id", F.array_join(nums, " ").alias("nums"), F.get(nums, F.lit(0)).cast("bigint").alias("first_num"))


@query(f"""with {RECORDS_SQL}, j as (select rec_id, array_to_string(toks, '') as s from records),
g as (select rec_id, case when length(s) >= 4 then list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4)) when length(s) > 0 then [s] else [] end as g from j)
select gram, count(*) as n, count(distinct rec_id) as df from (select rec_id, unnest(g) as gram from g) group by 1""")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = records(spark, sf).select("rec_id", F.explode(tokens.char_ngrams(F.array_join("toks", ""), 4)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("df"))


NEAR_SQL = f"""with {RECORDS_SQL}, near as (select a.rec_id as q_id, b.rec_id as i_id, a.toks as ta, b.toks as tb from records a join records b on b.rec_id = a.rec_id + 3)"""
URLS_SQL = "with near as (select a.page_id as q_id, b.page_id as i_id, a.url as x, b.url as y from pages a join pages b on b.page_id = a.page_id + 1)"


def _near(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with the one three ids on, a stand-in for candidates of one source."""
    rec = records(spark, sf)
    a = rec.select(F.col("rec_id").alias("q_id"), F.col("toks").alias("ta"))
    return a.join(rec.select(F.col("rec_id").alias("i_id"), (F.col("rec_id") - 3).alias("q_id"), F.col("toks").alias("tb")), "q_id")


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    """The address of each page with the next one's, whole: short texts whose scorers are quadratic."""
    page = table(spark, sf, "pages")
    a = page.select(F.col("page_id").alias("q_id"), F.col("url").alias("x"))
    return a.join(page.select(F.col("page_id").alias("i_id"), (F.col("page_id") - 1).alias("q_id"), F.col("url").alias("y")), "q_id")


@query(f"{URLS_SQL} select q_id, i_id, round(case when greatest(length(x), length(y)) = 0 then 1.0 else 1 - levenshtein(x, y) / greatest(length(x), length(y)) end, 6) as score from near")
def levenshtein_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("q_id", "i_id", F.round(sim.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"""{NEAR_SQL} select q_id, i_id, round(len(list_intersect(ta, tb)) / nullif(len(list_distinct(list_concat(ta, tb))), 0), 6) as score from near""")
def token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("q_id", "i_id", F.round(sim.jaccard(F.col("ta"), F.col("tb")), 6).alias("score"))


@query(f"{URLS_SQL} select q_id, i_id, round(jaro_winkler_similarity(x, y), 6) as score from near")
def jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("q_id", "i_id", F.round(sim.jaro_winkler("x", "y"), 6).alias("score"))


@query()
def indel_ratio_family(spark: SparkSession, sf: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6)
    return _urls(spark, sf).select("q_id", "i_id", r6(sim.indel_ratio("x", "y")).alias("ratio"), r6(sim.indel_partial("x", "y")).alias("partial"), r6(sim.indel_token_sort("x", "y")).alias("token_sort"), r6(sim.indel_token_set("x", "y")).alias("token_set"))


@query()
def nysiis_codes(spark: SparkSession, sf: str) -> DataFrame:
    toks = records(spark, sf).select(F.explode("toks").alias("tok")).distinct()
    return toks.select("tok", T.nysiis("tok").alias("code"))


@query(f"""{NEAR_SQL}, t as (select rec_id, unnest(toks) as term from records), tf as (select rec_id, term, count(*) as tf from t group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
w as (select rec_id, tf.term, (1 + ln(tf)) * (ln((1 + (select count(*) from records)) / (1 + df)) + 1) as w from tf join df on df.term = tf.term),
n as (select rec_id, sqrt(sum(w * w)) as norm from w group by 1),
u as (select w.rec_id, term, w / norm as w from w join n on n.rec_id = w.rec_id),
c as (select q_id, i_id, sum(a.w * b.w) as cos from near join u a on a.rec_id = q_id join u b on b.rec_id = i_id and b.term = a.term group by 1, 2)
select near.q_id, near.i_id, round(coalesce(cos, 0.0), 6) as cos from near left join c on c.q_id = near.q_id and c.i_id = near.i_id""")
def tfidf_pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    w = features.tfidf(records(spark, sf), "rec_id", "toks")
    pairs = _near(spark, sf).select("q_id", "i_id")
    return features.pair_cosine(pairs, w.withColumnRenamed("rec_id", "q_id"), w.withColumnRenamed("rec_id", "i_id")).select("q_id", "i_id", F.round("cos", 6).alias("cos"))


@query(f"""with {RECORDS_SQL}, n as (select rec_id, src, ckey, array_to_string(name, ' ') as name from records),
q as (select ckey, name, count(*) as n from n where src = 1 group by 1, 2), i as (select ckey, name, count(*) as n from n where src <> 1 group by 1, 2)
select rec_id, coalesce(q.n, 0) as name_df_s1, coalesce(i.n, 0) as name_df_idx from n left join q on q.ckey = n.ckey and q.name = n.name left join i on i.ckey = n.ckey and i.name = n.name""")
def name_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    named = records(spark, sf).select("rec_id", "src", "ckey", F.array_join("name", " ").alias("name"))
    counts = named.groupBy("ckey", "name").agg(F.count_if(F.col("src") == 1).alias("name_df_s1"), F.count_if(F.col("src") != 1).alias("name_df_idx"))
    return named.join(counts, ["ckey", "name"]).select("rec_id", "name_df_s1", "name_df_idx")


@query(f"""with {RECORDS_SQL}, pairs as (
    select distinct a.rec_id - a.rec_id % 50 as q_id, a.rec_id as i_id, round(((a.rec_id * 37) % 101) / 101, 4) as p from records a
), named as (select pairs.*, list_distinct(records.toks) as toks, row_number() over (partition by q_id order by p desc, i_id) as rk from pairs join records on rec_id = i_id),
o as (
    select x.q_id, x.i_id, t.rk, t.p, len(list_intersect(x.toks, t.toks)) / nullif(len(list_distinct(list_concat(x.toks, t.toks))), 0) as j,
        row_number() over (partition by x.q_id, x.i_id order by t.rk) as k
    from named x join named t on t.q_id = x.q_id and t.rk <= 3 and t.rk <> x.rk
), w as (
    select n.q_id, n.i_id, max(case when k = 1 then j end) as c1, max(case when k = 2 then j end) as c2, coalesce(max(case when k = 1 then o.p end), 0) as w1, coalesce(max(case when k = 2 then o.p end), 0) as w2
    from named n left join o on o.q_id = n.q_id and o.i_id = n.i_id group by 1, 2
)
select q_id, i_id, round(c1, 6) as c1, round(c2, 6) as c2, round((coalesce(c1, 0) * w1 + coalesce(c2, 0) * w2) / (w1 + w2 + 1e-6), 6) as support from w""")
def cluster_support(spark: SparkSession, sf: str) -> DataFrame:
    rec = records(spark, sf)
    pairs = rec.select((F.col("rec_id") - F.col("rec_id") % 50).alias("q_id"), F.col("rec_id").alias("i_id"), F.round((F.col("rec_id") * 37 % 101) / F.lit(101), 4).alias("p"))
    return features.cluster_support(pairs, rec.select(F.col("rec_id").alias("i_id"), F.array_distinct("toks").alias("toks")))


@query()
def noise_rule_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of addresses of neighbouring pages, host and path as name and address: how many, by quarter of the ids and for
    all, their share, and an example. Tests hold the tags against plain loops."""
    near = _urls(spark, sf).select("q_id", (F.col("q_id") % 4).alias("src"), *(F.regexp_replace(F.regexp_extract(c, "^[^/]*//([^/]*)", 1), r"\.", " ").alias(f"{c}n") for c in "xy"), *(F.regexp_replace(F.regexp_extract(c, "^[^/]*//[^/]*/(.*)$", 1), "[/&]", ", ").alias(f"{c}a") for c in "xy"))
    tags = near.select("q_id", "src", F.explode(F.concat(rules.name_tags(F.col("xn"), F.col("yn")), rules.address_tags(F.col("xa"), F.col("ya")))).alias("tag"))
    return metrics.tag_rates(tags, near, "src", "q_id")
