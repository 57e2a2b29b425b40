import hashlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat

from .helpers import rows, saved

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def sql(path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/conversations.parquet/*.parquet')")
    return sorted(con.execute(f"select {', '.join(COLS)} from ({chat.OP9_SQL})").fetchall(), key=repr)


def test_edges_equal_sql(spark, tmp_path):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b <\\s> [/INST] [\\\\ROLE]"), (1, 1, "assistant", "a</s>b <\\s> [/INST] [\\\\ROLE]"), (1, 2, "user", None),
        (2, None, None, "x\n\\<s>"), (2, 0, "assistant", ""), (2, 0, "user", "tie"), (None, 0, "assistant", "é中"), (3, 5, "[INST]", "[/ROLE] [INST] odd [/INST]"),
        (4, 0, "assistant", "long <s> " * 20_000), (5, 2, "user", "edited"), (6, 0, "user", " [INST] "),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumn("msg", F.lit(1)).withColumn("seq", F.lit("x"))
    path = saved(tmp_path, conversations=df)
    assert rows(chat.op9_chat_formatting(spark, path).select(COLS)) == sql(path)


def test_empty_table_has_the_probe_only(spark, tmp_path):
    path = saved(tmp_path, conversations=spark.createDataFrame([], SCHEMA))
    got = rows(chat.op9_chat_formatting(spark, path).select(COLS))
    assert got == sql(path) and got[0][:2] == (-1, 2)
    assert got[0][4] == hashlib.sha256(chat.PROBE.encode()).hexdigest()


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, "m", 0, "delta", "assistant", "dra"), (1, "m", 1, "delta", "assistant", "ft"), (1, "m", 2, "regen", "assistant", ""), (1, "m", 4, "delta", "assistant", "B"), (1, "m", 3, "delta", "assistant", "A"), (1, "u", -1, "delta", "user", "old"), (1, "u", 9, "edit", "user", "new"), (1, "u", 10, "delta", "user", "!")]
    got = chat.reconstruct(spark.createDataFrame(log, "conv_id long, msg string, seq long, kind string, role string, text string")).collect()
    assert [(m["role"], m["text"]) for m in got[0]["messages"]] == [("user", "new!"), ("assistant", "AB")]


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = ["<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST][/INST]", "[ROLE]", "plain", "", "<<s>s>", "[\\INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, u in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert u == t and not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


def test_main_path_is_native(spark, tmp_path):
    path = saved(tmp_path, conversations=spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))
    plan = chat.op9_chat_formatting(spark, path)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
