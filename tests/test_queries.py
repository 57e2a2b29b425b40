import os

import duckdb
import pytest

from tessera import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def normal(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    frame = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in frame.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(normal, r)) for r in con.execute(f"select {quoted} from ({catalogue.ORACLE_SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    """Each query that SQL can't express runs; test_functions and test_operators hold what it computes against loops."""
    frame = catalogue.QUERIES[name](spark, FOLDER)
    got = frame.collect()
    assert frame.columns and got and frame.columns == list(got[0].asDict())


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = row[:]
        for j, d in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if c == d else max(last[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def test_indel_query_equals_plain_tables(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in catalogue.QUERIES["indel_ratio_family"](spark, FOLDER).collect()[:25]:
        a, b = urls[r["q_id"]], urls[r["i_id"]]
        assert r["ratio"] == pytest.approx(plain_indel(a, b), abs=2e-6)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert r["partial"] == pytest.approx(max(plain_indel(short, w) for w in windows), abs=2e-6)


def test_flagship_reads_two_columns_and_has_no_product(spark):
    """The tokens are a table written before; the documents' columns are read for it."""
    from tessera.plans.fixtures import bench_tokens

    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(bench_tokens(spark, FOLDER)[1])
    flagship = plan(catalogue.FLAGSHIP(spark, FOLDER))
    assert "CartesianProduct" not in flagship and "doc_id:bigint,text:string" not in flagship
