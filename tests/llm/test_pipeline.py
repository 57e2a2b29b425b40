import random

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, pii

from .helpers import docs, rows, saved
from .test_ngram_join import brute

ITEM = "which of the seven green rivers flows uphill on the second sunday of a leap year in the north"


def world(spark, tmp_path):
    rng = random.Random(5)
    words = "the of and to in is was that for on with as by at from this river house green seven north second flows".split()
    text = lambda k: " ".join(rng.choices(words, k=k))
    base = text(60)
    data = [(i, text(rng.randint(8, 80)), "en", f"s{i % 2}") for i in range(40)]
    data += [(50, base, "en", "s0"), (51, base, "en", "s0"), (52, base + " extra", "en", "s1"), (53, base.upper(), "en", "s1")]
    data += [(60, text(20) + " " + ITEM, "en", "s0"), (61, ITEM.title() + "!", "en", "s0"), (62, text(30) + " mail me at jo.99@mail7.example.com or +1 (974) 555-3436", "en", "s0")]
    data += [(70, None, "en", "s0"), (71, "12 34 !!", "en", "s0"), (72, "", None, None), (45, text(25), "en", "s1"), (45, text(25), "en", "s1")]
    df = docs(spark, [(i, t, lang, s, len(t or "")) for i, t, lang, s in data])
    return df, saved(tmp_path, documents=df, benchmark=spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")), data


def test_run_equals_brute_force(spark, tmp_path):
    _, path, data = world(spark, tmp_path)
    kept = [(i, t) for i, t, *_ in data if t and any(c.isalpha() for c in t)]
    group = {i: c for i, _, c in brute([(i, t) for i, t in kept if i != 45])}
    kept = [(i, t) for i, t in kept if i == 45 or group[i] == i]
    kept = [(i, t) for i, t in kept if decontam.words(ITEM) != decontam.words(t) and b" ".join(decontam.words(ITEM)) not in b" ".join(decontam.words(t))]
    got = corpus_pipeline.run(spark, path).collect()
    ids = sorted(r["doc_id"] for r in got)
    assert ids == sorted(i for i, _ in kept) and {50, 45, 62} <= set(ids) and not {51, 52, 53, 60, 61, 70, 71, 72} & set(ids)
    library = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=bpe.codec(*bpe.default_vocabulary()).ranks, special_tokens={})
    texts = {i: pii.replace(t, pii.session_key(spark))[0] for i, t in kept if i != 45}
    for r in got:
        if r["doc_id"] != 45:
            assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert "jo.99" not in texts[62] and "555-3436" not in texts[62]


def test_stages_keep_columns_and_whole_rows(spark, tmp_path):
    df, path, _ = world(spark, tmp_path)
    wide = df.withColumn("n", F.lit(1)).withColumn("key", F.col("doc_id")).withColumn("component_id", F.lit("x")).withColumn("_x", F.lit(None).cast("string"))
    wide = wide.unionByName(wide.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, path)
        assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema], name
        assert out.where("doc_id is null").count() == 1 and out.where("doc_id between 1 and 39").count() >= 38, name
    assert len(rows(corpus_pipeline.tokens(spark, wide, path))) == wide.count()


def test_ids_that_name_several_texts_lose_copies_only(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(7, a), (7, b), (7, b), (7, b + " more"), (3, a), (9, c), (9, c), (None, "x"), (5, None), (5, None), (8, "y " * 50_000 + "z")]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, data, extra=True), str(tmp_path))
    assert rows(got.select("doc_id", "text")) == sorted([(7, b), (3, a), (9, c), (None, "x"), (5, None), (8, data[-1][1])], key=repr)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_empty_tables(spark, tmp_path, k):
    empty = docs(spark, [])
    path = saved(tmp_path, documents=empty, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.STAGES[k][1](spark, empty, path).count() == 0


def test_entry_registers_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) == 10 and "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
