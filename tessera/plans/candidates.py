"""Candidate generation over documents, passages and vectors."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.config import Config
from tessera.functions import text as T
from tessera.operators import blocking, bm25, dense, metrics, sampling, tokens
from tessera.plans.fixtures import BENCH_SQL, RECORDS_SQL, TRUTH_SQL, bench_tokens, bench_truth, folded_words, records
from tessera.plans.registry import query
from tessera.plans.skeleton_sql import SKELETON_SQL
from tessera.session import table, written

CONFIG = Config()

SIDES_SQL = f"""with {RECORDS_SQL}, side as (select rec_id, ckey, case when src = 1 then 'q' else 'i' end as side, name, addr, array_to_string(name, '') as concat from records),
raw as (
    select rec_id, ckey, 'core' as family, unnest(name) as tok from side
    union all select * from (select rec_id, ckey, 'alpha' as family, unnest(addr) as tok from side) where regexp_matches(tok, '^[a-z]{{3,}}$')
), once as (select distinct * from raw), toks as (select distinct tok from once), {SKELETON_SQL},
d as (
    select * from once
    union all select distinct rec_id, ckey, case family when 'core' then 'skel' else 'askel' end, skeleton from once join skeletons on skeletons.tok = once.tok where skeleton <> ''
), df as (select ckey, family, tok, count(*) as df from d group by 1, 2, 3 having count(*) >= 2),
rare as (select d.*, row_number() over (partition by d.ckey, rec_id, d.family order by df, d.tok) as rk from d join df on df.ckey = d.ckey and df.family = d.family and df.tok = d.tok),
num as (
    select rec_id, 'num' as family, cast(n as varchar) as tok, row_number() over (partition by rec_id order by pos) as rk
    from (select rec_id, cast(tok as bigint) as n, min(pos) as pos from (select rec_id, unnest(addr) as tok, generate_subscripts(addr, 1) as pos from side) where regexp_matches(tok, '^[0-9]{{1,12}}$') group by 1, 2)
), part as (select rec_id, family, tok, rk from rare union all select * from num),
kinds as (select * from (values ('NT', 'core', 2, 'alpha', 4), ('NS', 'skel', 2, 'askel', 3), ('AN', 'num', 2, 'alpha', 3), ('NH', 'core', 2, 'num', 2), ('NP', 'core', 3, 'core', 3)) as t(family, f1, k1, f2, k2)),
keys as (
    select s.ckey, s.rec_id, s.side, kinds.family, x.tok as a, y.tok as b
    from kinds join part x on x.family = f1 and x.rk <= k1 join part y on y.rec_id = x.rec_id and y.family = f2 and y.rk <= k2 join side s on s.rec_id = x.rec_id
    where kinds.family <> 'NP' or x.tok < y.tok
    union all select ckey, rec_id, side, 'NC', concat, '' from side where concat <> ''
), stats as (
    select i.ckey, i.family, i.a, i.b, df_i, df_q
    from (select ckey, family, a, b, count(*) as df_i from keys where side = 'i' group by 1, 2, 3, 4) i
    join (select ckey, family, a, b, count(*) as df_q from keys where side = 'q' group by 1, 2, 3, 4) q on q.ckey = i.ckey and q.family = i.family and q.a = i.a and q.b = i.b
), use as (select * from stats where df_i <= case when family in ('NP', 'NC') then 200 else 500 end and df_i * df_q <= 50000)"""


def _alpha() -> Column:
    return F.filter("addr", lambda w: w.rlike("^[a-z]{3,}$"))


def _word_sets(text: str | None) -> tuple[set[str], ...]:
    """Words and skeletons of a record's name, and those of its address that are letters."""
    toks = folded_words(text)
    half = (len(toks) + 1) // 2
    core, alpha = set(toks[:half]), {w for w in set(toks[half:]) if len(w) > 2 and w.isalpha()}
    return core, alpha, set(map(T.skeleton_of, core)) - {""}, set(map(T.skeleton_of, alpha)) - {""}


WORDS = tokens.Words(("text",), ("core", "alpha", "skel", "askel"), _word_sets)


@F.pandas_udf(StructType([StructField("nums", ArrayType(StringType())), StructField("concat", StringType())]))
def _numbers_and_name(texts: pd.Series) -> pd.DataFrame:
    """T.numbers of a record's address, and the digest of its name without blanks, empty if there is none."""
    out = []
    for text in texts:
        toks = folded_words(text)
        half = (len(toks) + 1) // 2
        nums = dict.fromkeys(str(int(w)) for w in toks[half:] if len(w) <= 12 and w.isdigit())
        out.append((list(nums)[:6], hashlib.sha256("".join(toks[:half]).encode()).hexdigest() if half else ""))
    return pd.DataFrame(out, columns=["nums", "concat"])


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Compound keys of six families (the seventh, by sound, isn't one that SQL can tell), written once. Names without
    blanks are as long as texts: their key is their SHA-256."""
    rec = records(spark, sf).withColumn("own", _numbers_and_name("text")).select(
        "ckey", F.col("rec_id").alias("id"), F.when(F.col("src") == 1, "q").otherwise("i").alias("side"), "text", "own.nums", "own.concat",
    )
    return written(blocking.compound_keys(rec, CONFIG.name_topk, CONFIG.addr_topk, CONFIG.num_topk, WORDS), "keys")


@query(f"with {RECORDS_SQL}, t as (select distinct rec_id, ckey, unnest(toks) as tok from records) select ckey, tok, count(*) as df from t group by 1, 2")
def token_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.document_frequency(tokens.token_rows(records(spark, sf), "toks", ["ckey", "rec_id"]), ["ckey"])


@query(f"""{SIDES_SQL} select rec_id, ckey, tok, cast(rk as integer) as rk from rare where family = 'alpha' and rk <= 4""")
def rarest_tokens_per_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens.token_rows(records(spark, sf).withColumn("alpha", _alpha()), "alpha", ["ckey", "rec_id"])
    return tokens.rarest_tokens(rows, tokens.document_frequency(rows, ["ckey"]), 4, "rec_id", keys=["ckey"]).select("rec_id", "ckey", "tok", "rk")


@query(f"""{SIDES_SQL} select ckey, family, count(*) as n_keys, cast(sum(df_i * df_q) as bigint) as join_rows, max(df_i) as max_df_i from use group by 1, 2""")
def compound_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    own = ["ckey", "family", "a", "b"]
    stats = blocking.usable(blocking.key_stats(keys.where("side = 'q'"), keys.where("side = 'i'"), own), CONFIG.max_df, CONFIG.max_pairs_per_key)
    return stats.groupBy("ckey", "family").agg(F.count("*").alias("n_keys"), F.sum(F.col("df_i") * F.col("df_q")).alias("join_rows"), F.max("df_i").alias("max_df_i"))


@query(f"""{SIDES_SQL}, n as (select ckey, count(*) as n from side where side = 'i' group by 1),
scored as (
    select q.ckey, q.rec_id as q_id, i.rec_id as i_id, round(sum(ln(1 + n / df_i)), 6) as score, bit_or(case q.family when 'NT' then 1 when 'NS' then 2 when 'AN' then 4 when 'NH' then 8 when 'NP' then 16 else 32 end) as bits
    from keys q join use u on u.ckey = q.ckey and u.family = q.family and u.a = q.a and u.b = q.b
    join keys i on i.side = 'i' and i.ckey = q.ckey and i.family = q.family and i.a = q.a and i.b = q.b join n on n.ckey = q.ckey
    where q.side = 'q' group by 1, 2, 3
)
select * from (select ckey, q_id, i_id, score, bits, cast(bit_count(bits) as integer) as n_families,
    cast(row_number() over (partition by ckey, q_id order by score desc, bit_count(bits) desc, i_id) as integer) as rk from scored) where rk <= {CONFIG.k_key}""")
def key_blocking_topk(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf)
    n = table(spark, sf, "documents").where("doc_id % 3 <> 0").groupBy(F.col("lang").alias("ckey")).agg(F.count("*").alias("n"))
    side = lambda s, name: keys.where(F.col("side") == s).select("ckey", F.col("id").alias(name), "family", "a", "b")
    return blocking.key_candidates(side("q", "q_id"), side("i", "i_id"), n, CONFIG.k_key, max_df=CONFIG.max_df, max_pairs=CONFIG.max_pairs_per_key)


PASSAGE_SQL = f"""with {BENCH_SQL}, it as (select distinct i_id, unnest(toks) as tok from bi), df as (select tok, count(*) as df from it group by 1),
qt as (select distinct q_id, unnest(toks) as tok from bq),
rare as (select * from (select q_id, qt.tok, df, row_number() over (partition by q_id order by df, qt.tok) as rk from qt join df on df.tok = qt.tok) where rk <= 4),
scored as (
    select q_id, i_id, round(sum(ln(1 + (select count(*) from bi) / df)), 6) as score from rare join it on it.tok = rare.tok where df <= 500 group by 1, 2
), ranked as (
    select * from (select *, row_number() over (partition by q_id order by score desc, i_id) as rk from scored) where rk <= 40
)"""


@query(f"{PASSAGE_SQL} select q_id, i_id, score, cast(rk as integer) as rk from ranked")
def benchmark_passage_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Passages meet all tokens of documents by their four rarest; tokens in over 500 documents don't count."""
    q, i = bench_tokens(spark, sf)
    asked = tokens.token_rows(q, "toks", ["q_id"])
    index = written(tokens.token_rows(i, "toks", ["i_id"]).join(asked.select("tok").distinct(), "tok", "left_semi"), "tokens")
    rare = tokens.rarest_tokens(asked, tokens.document_frequency(index), 4, "q_id", least=1).where("df <= 500").select("q_id", "tok", "df")
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    scored = index.join(rare, "tok").join(F.broadcast(n)).groupBy("q_id", "i_id").agg(F.round(F.sum(F.log1p(F.col("n") / F.col("df"))), 6).alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "i_id")
    return scored.withColumn("rk", F.row_number().over(w)).where("rk <= 40")


@query(f"""{PASSAGE_SQL}, {TRUTH_SQL}, per as (
    select bq.q_id, (select count(*) from truth t where t.q_id = bq.q_id) as truth, (select count(*) from ranked r where r.q_id = bq.q_id) as cands,
        (select count(*) from truth t join ranked r on r.q_id = t.q_id and r.i_id = t.i_id where t.q_id = bq.q_id) as found
    from bq
)
select count(*) as n_queries, cast(sum(truth) as bigint) as n_truth, cast(sum(found) as bigint) as n_found, round(sum(found) / greatest(sum(truth), 1), 6) as recall,
    round(avg(case when truth = 0 then (case when found = 0 then 1.0 else 0.0 end) when found = 0 then 0.0 else 1.25 * found / (0.25 * truth + found) end), 6) as oracle_f05,
    round(avg(cands), 6) as cands_per_query, count(*) filter (found < truth) as missing_some, count(*) filter (cands = 0) as no_candidates,
    round(1 - sum(cands) / (count(*) * (select count(*) from bi)), 6) as reduction_ratio from per""")
def blocking_quality(spark: SparkSession, sf: str) -> DataFrame:
    q, i = bench_tokens(spark, sf)
    return metrics.blocking_report(bench_truth(spark, sf), benchmark_passage_linkage(spark, sf), q.select("q_id"), i.count())


BM25_SQL = f"""with {BENCH_SQL}, len as (select i_id, len(toks) as len from bi), tot as (select count(*) as n, avg(len) as avgdl from len),
it as (select i_id, unnest(toks) as tok from bi), tf as (select i_id, tok, count(*) as tf from it group by 1, 2), df as (select tok, count(*) as df from tf group by 1),
qt as (select distinct q_id, unnest(toks) as tok from bq),
w as (
    select tf.i_id, tf.tok, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) as w
    from tf join df on df.tok = tf.tok join len on len.i_id = tf.i_id cross join tot where df <= greatest(50.0, 0.2 * n)
), bscored as (select q_id, i_id, round(sum(w), 6) as score from qt join w on w.tok = qt.tok group by 1, 2),
bm as (select * from (select *, row_number() over (partition by q_id order by score desc, i_id) as rk from bscored where score > 0) where rk <= 40)"""


@query(f"{BM25_SQL} select q_id, i_id, score, cast(rk as integer) as rk from bm where rk <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.top_k(*bench_tokens(spark, sf), 10)


@query(f"""{BM25_SQL} select q_id, bm.i_id, score, cast(rk as integer) as rk from bm join bi on bi.i_id = bm.i_id
where rk <= 5 or (rk <= 40 and len(list_filter(toks, lambda t: regexp_matches(t, '^[0-9]+$'))) = 0)""")
def bm25_empty_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Deeper ranks stay for index records that lack a part that tells records apart; in texts that is a number."""
    q, i = bench_tokens(spark, sf)
    bare = i.where(~F.exists("toks", lambda t: t.rlike("^[0-9]+$"))).select("i_id", F.lit(True).alias("flag"))
    ranked = bm25.top_k(q, i, 40).join(bare, "i_id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    return bm25.keep_by_rank(ranked, "flag", CONFIG.k_bm25, CONFIG.k_bm25_empty).drop("flag").select("q_id", "i_id", "score", "rk")


DENSE_SQL = f"""with s as (
    select q.vec_id as q_id, i.vec_id as i_id, round(list_dot_product(q.embedding::double[], i.embedding::double[]), 6) as score
    from embeddings q join embeddings i on i.label = q.label and i.vec_id <> q.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by q_id order by score desc, i_id) as rk from s)"""


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The stated queries, ids divisible by 100, against all other rows."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return dense.top_k(v.where("vec_id % 100 = 0"), v, k, exclude_self=True)


@query(f"{DENSE_SQL} select q_id, i_id, score, cast(rk as integer) as rk from r where rk <= {CONFIG.k_dense}")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, CONFIG.k_dense)


@query(f"""{DENSE_SQL}, native as (select doc_id from documents where regexp_matches(text, '[^\\x00-\\x7F]'))
select q_id, i_id, score, cast(rk as integer) as rk from r where rk <= {CONFIG.k_dense} or (rk <= {CONFIG.k_dense_script} and (q_id in (select doc_id from native) or i_id in (select doc_id from native)))""")
def dense_budget_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Deeper ranks stay where either side's text, the document of its id, has letters beyond ASCII."""
    native = table(spark, sf, "documents").where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id").distinct()
    ranked = _dense(spark, sf, CONFIG.k_dense_script)
    for c in ("q", "i"):
        ranked = ranked.join(native.select(F.col("doc_id").alias(f"{c}_id"), F.lit(True).alias(f"{c}_native")), f"{c}_id", "left")
    flagged = ranked.withColumn("flag", F.coalesce("q_native", "i_native", F.lit(False)))
    return bm25.keep_by_rank(flagged, "flag", CONFIG.k_dense, CONFIG.k_dense_script).select("q_id", "i_id", "score", "rk")


UNION_SQL = f"{PASSAGE_SQL}, {BM25_SQL.removeprefix(f'with {BENCH_SQL}, ').replace('it as', 'bt as', 1).replace('from it group', 'from bt group', 1).replace('df as (', 'bdf as (', 1).replace('join df on df.tok', 'join bdf on bdf.tok', 1).replace('qt as', 'bqt as', 1).replace('from qt join w on w.tok = qt.tok', 'from bqt join w on w.tok = bqt.tok', 1)}"


@query(f"""{UNION_SQL}
select coalesce(r.q_id, b.q_id) as q_id, coalesce(r.i_id, b.i_id) as i_id, coalesce(r.score, 0.0) as score,
    case when r.q_id is null then 0 else 1 end | case when b.q_id is null then 0 else 256 end as bits, cast(coalesce(r.rk, 90) as integer) as rk
from ranked r full join (select * from bm where rk <= 5) b on b.q_id = r.q_id and b.i_id = r.i_id""")
def candidate_union_bits(spark: SparkSession, sf: str) -> DataFrame:
    keyed = benchmark_passage_linkage(spark, sf).withColumn("bits", F.lit(1))
    return blocking.merged(keyed, bm25.top_k(*bench_tokens(spark, sf), 5), "BM25", 40)


@query(f"""{UNION_SQL}, {TRUTH_SQL}, hits as (
    select t.q_id, r.q_id is not null as keyed, b.rk from truth t left join ranked r on r.q_id = t.q_id and r.i_id = t.i_id left join bm b on b.q_id = t.q_id and b.i_id = t.i_id
)
select k, count(*) filter (rk <= k) as bm25_found, count(*) filter (keyed or rk <= k) as union_found, count(*) as n_truth
from hits cross join (select unnest([5, 10, 20, 40]) as k) group by 1""")
def union_rescue_curve(spark: SparkSession, sf: str) -> DataFrame:
    truth = bench_truth(spark, sf)
    keyed = benchmark_passage_linkage(spark, sf).select("q_id", "i_id").withColumn("keyed", F.lit(1))
    ranked = bm25.top_k(*bench_tokens(spark, sf), 40).select("q_id", "i_id", "rk")
    hits = truth.join(keyed, ["q_id", "i_id"], "left").join(ranked, ["q_id", "i_id"], "left")
    cols = [F.struct(F.lit(k).alias("k"), F.sum(F.coalesce((F.col("rk") <= k).cast("int"), F.lit(0))).alias("bm25_found"), F.sum(F.coalesce("keyed", (F.col("rk") <= k).cast("int"), F.lit(0))).alias("union_found"), F.count("*").alias("n_truth")) for k in (5, 10, 20, 40)]
    return hits.agg(F.array(*cols).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query(f"""with {RECORDS_SQL},
q as (select rec_id, case when rec_id % 11 = 0 then '' else ckey end as ckey from records where src = 1),
i as (select rec_id, case when rec_id % 13 = 0 then '' else ckey end as ckey from records where src <> 1)
select q.ckey, count(distinct q.rec_id) as n_query, (select count(*) from i where i.ckey = q.ckey or i.ckey = '') as n_index from q group by 1""")
def country_partition_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions with the index rows of a blank partition in all of them; here some ids have a blank one on either side.
    A query of a blank partition meets the blank rows only."""
    rec = records(spark, sf).select("rec_id", "src", "ckey")
    blank = lambda rows, n: rows.select("rec_id", F.when(F.col("rec_id") % n == 0, "").otherwise(F.col("ckey")).alias("ckey"))
    q, i = blank(rec.where("src = 1"), 11), blank(rec.where("src <> 1"), 13)
    spread = blocking.replicated(i, q.select("ckey").distinct())
    return q.groupBy("ckey").agg(F.countDistinct("rec_id").alias("n_query")).join(spread.groupBy("ckey").agg(F.count("*").alias("n_index")), "ckey", "left").na.fill(0, ["n_index"])


@query(f"""with {RECORDS_SQL}, keyed as (select rec_id, src, case when rec_id % 17 = 0 then '' else array_to_string(name, ' ') end as id from records),
s2 as (select * from (select *, row_number() over (partition by id order by rec_id) as o from keyed where src = 2 and id <> '') where o = 1),
s3 as (select * from (select *, row_number() over (partition by id order by rec_id) as o from keyed where src = 3 and id <> '') where o = 1)
select rec_id, src, id from s2 union all select rec_id, src, id from s3 where id not in (select id from s2)""")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = records(spark, sf).select("rec_id", "src", F.when(F.col("rec_id") % 17 == 0, "").otherwise(F.array_join("name", " ")).alias("id"))
    second, third = (sampling.first_wins(keyed.where(F.col("src") == s), "id", "rec_id") for s in (2, 3))
    return second.unionByName(third.join(second.select("id"), "id", "left_anti"))


@query(r"""select lang, count(*) as n, count(*) filter (regexp_matches(regexp_replace(text, '[\x{0000}-\x{024F}]', '', 'g'), '\p{L}')) as native,
    count(*) filter (regexp_matches(text, '[^\x00-\x7F]') and not regexp_matches(text, '[A-Za-z]')) as non_latin,
    count(*) filter (not regexp_matches(lower(strip_accents(text)), '[a-z]')) as unlettered from documents group by 1""")
def script_flags(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.has_native(text)).alias("native"), F.count_if(T.non_latin(text)).alias("non_latin"), F.count_if(T.is_unlettered(text)).alias("unlettered"))
