"""The driver tables seen as linkage inputs, in DataFrames and in the same SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"


def folded_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, Latin accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit("([a-z0-9]+)"), F.lit(1))


_FOLDS, _RUNS = str.maketrans(ACCENTED, PLAIN), re.compile("[a-z0-9]+")


def folded_words(text: str | None) -> list[str]:
    """folded_tokens, outside of Spark."""
    low = (text or "").lower()
    return _RUNS.findall(low if low.isascii() else low.translate(_FOLDS))


TOKENS_SQL = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{ACCENTED}', '{PLAIN}'), '[a-z0-9]+')"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, i_id, p, y): lines of an order as scored candidates."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("q_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 10).alias("i_id")).agg(
        F.max(F.round(0.05 + 9 * F.col("l_discount"), 4)).alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y")
    )


PAIRS_SQL = """pairs as (
    select l_orderkey as q_id, l_partkey * 1000 + l_suppkey % 10 as i_id, max(round(0.05 + 9 * l_discount, 4)) as p,
        max(case when l_returnflag = 'R' then 1 else 0 end) as y
    from lineitem group by 1, 2
)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, truth, segment) of all orders, those without pairs too."""
    truth = pairs(spark, sf).groupBy("q_id").agg(F.sum("y").alias("truth"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("segment"))
    return orders.join(truth, "q_id", "left").na.fill({"truth": 0})


ENTITIES_SQL = """entities as (
    select o_orderkey as q_id, o_orderpriority as segment, coalesce(truth, 0) as truth
    from orders left join (select q_id, sum(y) as truth from pairs group by 1) t on t.q_id = o_orderkey
)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """(rec_id, src, ckey, text, toks, name, addr): a document as a record of one of three sources; the first half of its words
    is the name, the rest the address."""
    half = F.expr("(size(toks) + 1) div 2")
    docs = table(spark, sf, "documents").withColumn("toks", folded_tokens(F.col("text")))
    return docs.select(
        F.col("doc_id").alias("rec_id"), (1 + F.col("doc_id") % 3).alias("src"), F.col("lang").alias("ckey"), "text", "toks",
        F.slice("toks", F.lit(1), half).alias("name"), F.slice("toks", half + 1, F.size("toks")).alias("addr"),
    )


RECORDS_SQL = f"""records as (
    select rec_id, src, ckey, toks, toks[1:(len(toks) + 1) // 2] as name, toks[(len(toks) + 1) // 2 + 1:] as addr
    from (select doc_id as rec_id, 1 + doc_id % 3 as src, lang as ckey, {TOKENS_SQL} as toks from documents)
)"""


def bench_tokens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages (q_id, toks) and documents (i_id, toks)."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), folded_tokens(F.col("text")).alias("toks"))
    i = table(spark, sf, "documents").select(F.col("doc_id").alias("i_id"), folded_tokens(F.col("text")).alias("toks"))
    return q, i


BENCH_SQL = f"""bq as (select item_id as q_id, {TOKENS_SQL} as toks from benchmark),
bi as (select doc_id as i_id, {TOKENS_SQL} as toks from documents)"""


def bench_truth(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, i_id) where the document contains the passage. The pairs to compare are those that share the
    passage's rarest token, so the passages meet the documents in an equi-join."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    from tessera.operators.tokens import rarest_tokens

    q, i = bench_tokens(spark, sf)
    index = i.select("i_id", F.explode(F.array_distinct("toks")).alias("tok"))
    df = index.groupBy("tok").agg(F.count("*").alias("df"))
    key = rarest_tokens(q.select("q_id", F.explode(F.array_distinct("toks")).alias("tok")), df, 1, "q_id", least=1)
    near = key.join(index, "tok").select("q_id", "i_id")
    named = near.join(bench.select(F.col("item_id").alias("q_id"), F.col("text").alias("passage")), "q_id").join(docs.select(F.col("doc_id").alias("i_id"), "text"), "i_id")
    return named.where(F.col("text").contains(F.col("passage"))).select("q_id", "i_id")


TRUTH_SQL = "truth as (select item_id as q_id, doc_id as i_id from benchmark b join documents d on contains(d.text, b.text))"
