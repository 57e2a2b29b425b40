"""Tab-separated sources and id lists: reading, writing, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = ("entity_id", "business_name", "business_address", "country")
PREFIXES = ("S2-", "S3-")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of non-blank lines in file order, without BOM and carriage returns. Undecodable bytes are
    replaced."""
    raw = spark.read.text(path).select(F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("pos"), F.make_valid_utf8("value").alias("value"))
    clean = raw.withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))
    return clean.where(F.trim("value") != "")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entity_id, business_name, business_address, country) of a TSV without quoting. Header names in any
    case and order; absent columns are empty; with the usual header, surplus tabs belong to the address; short
    rows are padded; fields are trimmed. Of repeated ids the first row stays, rows without id go."""
    lines = _lines(spark, path)
    first = lines.orderBy("pos").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "pos struct<a: string, b: long>, " + ", ".join(f"{c} string" for c in HEADER))
    names = [n.strip().lower() for n in first[0]["value"].split("\t")]
    rows = lines.where(F.col("pos") != F.struct(F.lit(first[0]["pos"][0]), F.lit(first[0]["pos"][1]))).withColumn("p", F.split("value", "\t", -1))
    size = len(names)
    if tuple(names) == HEADER:
        extra = F.size("p") - size
        glued = F.concat(F.slice("p", 1, 2), F.array(F.array_join(F.slice(F.col("p"), F.lit(3), extra + 1), " ")), F.slice(F.col("p"), F.size("p"), F.lit(1)))
        rows = rows.withColumn("p", F.when(extra > 0, glued).otherwise(F.col("p")))
    field = lambda name: F.trim(F.coalesce(F.get("p", F.lit(names.index(name))), F.lit(""))) if name in names else F.lit("")
    out = rows.select("pos", *(field(c).alias(c) for c in HEADER)).where("entity_id <> ''")
    w = Window.partitionBy("entity_id").orderBy("pos")
    return out.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def index_relation(second: DataFrame, third: DataFrame) -> DataFrame:
    """Both index sources with src 2 and 3; ids of the third that the second has go."""
    rest = third.join(second.select("entity_id"), "entity_id", "left_anti")
    return second.withColumn("src", F.lit(2).cast("tinyint")).unionByName(rest.withColumn("src", F.lit(3).cast("tinyint")))


def read_id_rows(spark: SparkSession, path: str) -> DataFrame:
    """(pos, s1, ids) of every line of a list file, with or without header."""
    lines = _lines(spark, path)
    rows = lines.select("pos", F.trim(F.substring_index("value", "\t", 1)).alias("s1"), F.when(F.instr("value", "\t") > 0, F.expr("substr(value, instr(value, '\t') + 1)")).otherwise("").alias("rest"))
    rows = rows.where("s1 not like 'source1_%'").withColumn("ids", F.filter(F.transform(F.split("rest", ","), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select("pos", "s1", "ids")


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(pos, s1, ids) of a list file; of repeated first ids the last line stays."""
    rows = read_id_rows(spark, path)
    w = Window.partitionBy("s1").orderBy(F.desc("pos"))
    return rows.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").select("pos", "s1", "ids")


def cleaned(ids: Column) -> Column:
    """Distinct ids in order, of the index sources only."""
    return F.array_distinct(F.filter(ids, lambda x: x.startswith(PREFIXES[0]) | x.startswith(PREFIXES[1])))


def ranked_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_id, ids) and pos if the entities have it: a row for each entity, ids by falling p, joined by commas; empty where
    none."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("id").alias("id"))))
    lists = pairs.groupBy("q_id").agg(F.transform(order, lambda x: x["id"]).alias("ids"))
    pos = ["pos"] if "pos" in entities.columns else []
    return entities.select("q_id", *pos).join(lists, "q_id", "left").select("q_id", *pos, F.array_join(F.coalesce(cleaned(F.col("ids")), F.array()), ",").alias("ids"))


def write_id_lists(lists: DataFrame, path: str, header: str, order: str = "q_id") -> None:
    """A folder of text files whose names sort as their lines do: header, then a line for each entity in order. Sorting is
    by range in as many tasks as there are cores; no task holds all lines."""
    lines = lists.select(F.lit(1).alias("at"), F.col(order).alias("by"), F.concat_ws("\t", F.col("q_id").cast("string"), "ids").alias("value"))
    first = lists.limit(1).select(F.lit(0).alias("at"), F.lit(None).cast(lines.schema["by"].dataType).alias("by"), F.lit(f"source1_entity_id\t{header}").alias("value"))
    if not lists.take(1):
        first = lists.sparkSession.createDataFrame([(0, None, f"source1_entity_id\t{header}")], "at int, by string, value string")
        lines = first.limit(0)
    first.unionAll(lines).orderBy("at", "by").select("value").write.mode("overwrite").text(path)


def list_checks(lists: DataFrame, required: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(check, n): counts of repeated rows, repeated ids within a list, self matches, wrong prefixes, unknown
    ids, missing and surplus entities, and lists that hold ids which aren't candidates. lists: (s1, ids)."""
    ids = lists.select("s1", F.explode("ids").alias("id"))
    seen = lists.select("s1").distinct()
    checks = {
        "repeated_row": lists.groupBy("s1").count().where("count > 1"),
        "repeated_id": lists.where(F.size("ids") != F.size(F.array_distinct("ids"))),
        "self_match": lists.where(F.exists("ids", lambda x: x.startswith("S1-"))),
        "wrong_prefix": lists.where(F.exists("ids", lambda x: ~x.rlike("^S[123]-"))),
        "unknown_id": ids.select("id").distinct().join(known, "id", "left_anti"),
        "missing_entity": required.select("s1").distinct().join(seen, "s1", "left_anti"),
        "surplus_entity": seen.join(required.select("s1").distinct(), "s1", "left_anti"),
    }
    if candidates is not None:
        checks["not_candidate"] = ids.join(candidates, ["s1", "id"], "left_anti").select("s1").distinct()
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def file_faults(spark: SparkSession, path: str, header: str) -> list[str]:
    """Faults of a list file as a whole: empty, commas for tabs, another header, lines without a tab."""
    lines = _lines(spark, path)
    first = lines.orderBy("pos").limit(1).collect()
    if not first:
        return ["empty file"]
    out, top = [], first[0]["value"]
    if top != f"source1_entity_id\t{header}":
        out.append("comma-separated" if "\t" not in top and "," in top else "unexpected header")
    bad = lines.where(F.instr("value", "\t") == 0).count()
    return out + [f"{bad} lines without a tab"] * bool(bad)
