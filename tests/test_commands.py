import json

from tessera.__main__ import main, parsed
from pyspark.sql import functions as F
from tessera.operators import bm25, learning
from tessera.plans import diagnose
from tessera.sources import lists
from tessera.streaming import lookup

TRUTH = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-3\n"
PREDICTED = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-9\nS1-2\t\n"


def files(tmp_path):
    out = []
    for name, text in (("t.tsv", TRUTH), ("p.tsv", PREDICTED), ("s.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\nS1-3\ta\tb\tIN\n")):
        (tmp_path / name).write_text(text)
        out.append(str(tmp_path / name))
    return out


def test_score_report(spark, tmp_path):
    truth, predicted, source = files(tmp_path)
    got = {r["segment"]: r for r in diagnose.score(spark, truth, predicted, source).collect()}
    f = 1.25 / (0.5 + 2)
    assert round(got["ALL"]["macro_f05"], 6) == round((f + 1 + 0) / 3, 6) and got["us"]["n_entities"] == 2 and got["in"]["macro_f05"] == 0
    assert (got["ALL"]["tp"], got["ALL"]["fp"], got["ALL"]["fn"]) == (1, 1, 2)
    perfect = {r["segment"]: r["macro_f05"] for r in diagnose.score(spark, truth, truth).collect()}
    assert set(perfect.values()) == {1.0}


def test_other_reports(spark, tmp_path):
    truth, predicted, _ = files(tmp_path)
    assert diagnose.blocking(spark, truth, predicted, 10).first()["n_found"] == 1
    assert diagnose.owners(spark, truth).count() == 0
    assert {(r["kind"], r["src"]): r["violations"] for r in diagnose.caps(spark, truth, predicted).collect()}["truth", 2] == 0
    assert diagnose.holdout(spark, truth, 0.5).count() <= 3
    assert lists.file_faults(spark, truth, "matched_entity_ids") == []
    (tmp_path / "bad.tsv").write_text("a,b\nx\n")
    assert lists.file_faults(spark, str(tmp_path / "bad.tsv"), "matched_entity_ids") == ["comma-separated", "2 lines without a tab"]


def test_errors_by_class_and_full_validation(spark, tmp_path):
    truth, predicted, source = files(tmp_path)
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1,S3-9\nS1-2\tS2-3\nS1-3\t\n")
    (tmp_path / "more.tsv").write_text(PREDICTED.replace("S1-2\t\n", "S1-2\tS2-3,S2-8\n"))
    got = {(r["segment"], r["class"]): r["n"] for r in diagnose.errors(spark, truth, str(tmp_path / "more.tsv"), str(tmp_path / "c.tsv"), source, str(tmp_path / "wrong")).collect()}
    assert got["ALL", "missed_in_candidates"] == 1 and got["ALL", "blocking_miss"] == 1 and got["ALL", "fp_distractor"] == 1 and got["ALL", "fp_on_singleton"] == 2 and ("us", "blocking_miss") not in got
    assert len("".join(p.read_text() for p in (tmp_path / "wrong").glob("part-*")).splitlines()) == 5
    recall = {(r["segment"], r["src"]): r["recall"] for r in diagnose.blocking_by_source(spark, truth, str(tmp_path / "c.tsv"), source).collect()}
    assert recall["ALL", "ALL"] == round(2 / 3, 6) and recall["ALL", "S2"] == 0.5 and recall["us", "S3"] == 1.0
    (tmp_path / "i.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\ta\tb\tUS\nS3-9\ta\tb\tUS\n")
    checks = {r["check"]: r["n"] for r in diagnose.checked(spark, predicted, "matched_entity_ids", source, [str(tmp_path / "i.tsv")], str(tmp_path / "c.tsv")).collect()}
    assert checks["missing_entity"] == 1 and sum(checks.values()) == 1
    assert diagnose.sampled_lists(spark, truth, 2).count() < 3 and diagnose.sampled_lists(spark, truth, 1, spark.createDataFrame([("S1-3",)], "q_id string")).count() == 1


def test_rerank_touches_the_shortlist_only(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.5), (2, 2, 0.01), (3, 3, 0.4)], "q_id long, i_id long, p double")
    assert sorted((r["q_id"], r["i_id"]) for r in learning.shortlist(pairs).collect()) == [(1, 1), (3, 3)] and learning.shortlist(pairs, n=1).first()["q_id"] == 1
    scores = pairs.select("q_id", "i_id").withColumn("logit", F.lit(0.0))
    got = {(r["q_id"], r["i_id"]): round(r["p"], 6) for r in learning.reranked(pairs, scores, 0.5).collect()}
    assert got == {(1, 1): 0.7, (2, 1): 0.5, (2, 2): 0.01, (3, 3): 0.45}


def test_command_line(spark, tmp_path, capsys):
    truth, predicted, source = files(tmp_path)
    assert main(["score", truth, predicted, "--source", source]) == 0 and "macro_f05" in capsys.readouterr().out
    assert main(["validate", truth, "matched_entity_ids"]) == 0
    assert parsed(["train", "d", "m", "--k-key", "7", "--train-countries", "us", "in"]).k_key == 7
    assert json.dumps(vars(parsed(["holdout", "x"])))


def test_streamed_lookup_equals_batch(spark, tmp_path):
    index = spark.createDataFrame([(i, [f"t{i % 5}", f"t{i % 3}", f"u{i}"]) for i in range(40)], "i_id long, toks array<string>")
    queries = spark.createDataFrame([(q, [f"t{q % 5}", f"u{q}"]) for q in range(12)], "q_id long, toks array<string>")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lookup.candidate_stream(stream, lookup.static_index(index), 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("q_id", "i_id", "score", "rk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.top_k(queries, index, 3).collect()))
