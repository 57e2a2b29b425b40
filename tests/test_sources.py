from pyspark.sql import functions as F

from tessera.sources import lists


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def read(spark, path):
    return [tuple(r)[1:] for r in lists.read_source(spark, path).orderBy("pos").collect()]


def test_malformed_rows(spark, tmp_path):
    text = "﻿Entity_ID\tbusiness_name\tBusiness_Address\tcountry\r\nS1-1\t A \tx\tUS\r\n\r\nS1-2\tB\tpart one\tpart two\tIN\r\nS1-3\tC\r\n\tno id\tx\tUS\r\nS1-1\tlater\ty\tUS\r\n".encode() + b"S1-4\tbad\xff\tz\tFR\n"
    got = read(spark, write(tmp_path / "a.tsv", text))
    assert got == [("S1-1", "A", "x", "US"), ("S1-2", "B", "part one part two", "IN"), ("S1-3", "C", "", ""), ("S1-4", "bad�", "z", "FR")]


def test_other_headers_and_empty_files(spark, tmp_path):
    assert read(spark, write(tmp_path / "b.tsv", "country\tentity_id\textra\nUS\tS1-9\tq\tsurplus\n")) == [("S1-9", "", "", "US")]
    assert read(spark, write(tmp_path / "c.tsv", "")) == []
    assert read(spark, write(tmp_path / "d.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\n")) == []


def test_third_source_loses_to_second(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "entity_id string")
    got = lists.index_relation(rows("a", "b"), rows("b", "c")).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 2), ("c", 3)]


def test_id_lists_last_row_wins(spark, tmp_path):
    path = write(tmp_path / "g.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,\nS1-2\t\nS1-1\tS2-5\nS1-3\n")
    assert sorted((r["s1"], r["ids"]) for r in lists.read_id_lists(spark, path).collect()) == [("S1-1", ["S2-5"]), ("S1-2", []), ("S1-3", [])]


def test_written_lists_keep_all_entities_in_order(spark, tmp_path):
    entities = spark.createDataFrame([("S1-2",), ("S1-1",)], "q_id string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.4), ("S1-1", "S3-1", 0.9), ("S1-1", "X-1", 1.0)], "q_id string, id string, p double")
    lists.write_id_lists(lists.ranked_lists(entities, pairs), str(tmp_path / "out"), "matched_entity_ids")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS3-1,S2-1\nS1-2\t\n"


def test_checks_count_each_fault(spark):
    rows = [("S1-1", ["S2-1", "S2-1"]), ("S1-2", ["S1-1"]), ("S1-2", ["Q-1"]), ("S1-9", ["S3-7"])]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    required = ids("S1-1", "S1-2", "S1-3").withColumnRenamed("id", "s1")
    candidates = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, id string")
    got = dict(map(tuple, lists.list_checks(spark.createDataFrame(rows, "s1 string, ids array<string>"), required, ids("S2-1", "S1-1", "Q-1"), candidates).collect()))
    assert got == {"repeated_row": 1, "repeated_id": 1, "self_match": 1, "wrong_prefix": 1, "unknown_id": 1, "missing_entity": 1, "surplus_entity": 1, "not_candidate": 2}
    assert F is not None
