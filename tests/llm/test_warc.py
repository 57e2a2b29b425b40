import gzip
import random

import duckdb

from tessera.llm import warc

from .helpers import rows, saved

PAGES = "page_id long, url string, html string"


def some(n, rng):
    return [(i, f"http://h/{i}\r\nX", "".join(rng.choice("ab <p>é\n") for _ in range(rng.randint(0, 300)))) for i in range(n)]


def test_query_equals_sql(spark, tmp_path):
    long = "<p>" + "x" * 200
    data = some(60, random.Random(1)) + [(100, None, None), (101, "u", long), (102, "u", long), (7, "u", long), (7, "u", long), (None, "u", long), (103, "u", "short"), (104, "u", "short"), (105, "u", "y" * 300_000), (106, "u", "WARC/1.1\r\n\r\n" * 20)]
    path = saved(tmp_path, pages=spark.createDataFrame([(*r, "x") for r in data], PAGES + ", refers_to string"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/pages.parquet/*.parquet')")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"select {', '.join(cols)} from ({warc.OP1_SQL})").fetchall()
    assert rows(warc.op1_warc(spark, path).select(cols)) == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    path = saved(tmp_path, pages=spark.createDataFrame([], PAGES))
    assert rows(warc.op1_warc(spark, path)) == []


def records():
    return [warc.member(i, "u", "response", None, __import__("hashlib").sha256(b"p%d" % i * 40).hexdigest(), b"p%d" % i * 40) for i in range(6)]


def salvaged(data):
    found, gaps, at = [], [], 0
    for kind, start, stop, inner, _, x in warc.salvage(data):
        assert start >= at or inner is not None
        at = stop
        if kind == "gap":
            gaps.append((start, stop))
        else:
            found.append(x["payload"])
    return found, gaps


def test_salvage_recovers_after_damage():
    parts = records()
    good = [b"p%d" % i * 40 for i in range(6)]
    assert salvaged(b"".join(parts)) == (good, [])
    cut = parts[0] + parts[1][:-20] + b"".join(parts[2:])
    assert salvaged(cut) == ([good[0], *good[2:]], [(len(parts[0]), len(parts[0]) + len(parts[1]) - 20)])
    flipped = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    flipped[at] ^= 255
    found, gaps = salvaged(bytes(flipped))
    assert found == [good[0], *good[2:]] and gaps == [(len(parts[0]), len(parts[0] + parts[1]))]
    assert salvaged(b"junk" + parts[0] + b"tail") == ([good[0]], [(0, 4), (4 + len(parts[0]), 8 + len(parts[0]))])
    plain = [gzip.decompress(p) for p in parts]
    wrong = plain[1].replace(b"p1p1", b"p1q1", 1)
    assert salvaged(plain[0] + wrong + plain[2] + parts[3])[0] == [good[0], good[2], good[3]]
    assert salvaged(b"") == ([], []) and salvaged(b"zz") == ([], [(0, 2)])


def test_any_damaged_byte_loses_one_record_at_most():
    parts, rng = records(), random.Random(3)
    whole = b"".join(parts)
    for _ in range(60):
        broken = bytearray(whole)
        broken[rng.randrange(len(whole))] ^= 1 << rng.randrange(8)
        assert len(salvaged(bytes(broken))[0]) >= 5


def test_archive_files_round_trip_with_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 100), (2, "u", "é" * 100), (3, None, "")], PAGES)
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w", payloads=True).where("kind = 'record'").select("page_id", "record_type", "payload").collect()
    assert sorted((r[0], r[1], bytes(r[2]).decode()) for r in got) == [(1, "response", "é" * 100), (2, "revisit", ""), (3, "response", "")]
    assert warc.read(spark, f"{tmp_path}/w").where("kind = 'gap'").count() == 0


def packed(parts):
    return gzip.compress(b"".join(gzip.decompress(p) for p in parts), mtime=0)


def kinds(data):
    return [(kind, None if kind == "gap" else x["payload"]) for kind, *_, x in warc.salvage(data)]


def test_bad_record_inside_a_member_costs_itself():
    plain = [gzip.decompress(p) for p in records()[:4]]
    wrong = plain[1].replace(b"p1p1", b"p1q1", 1)
    data = gzip.compress(plain[0] + wrong + plain[2] + plain[3])
    good = [b"p%d" % i * 40 for i in (0, 2, 3)]
    found = list(warc.salvage(data))
    assert [x["payload"] for kind, *_, x in found if kind == "record"] == good
    gaps = [row for row in found if row[0] == "gap"]
    assert [(g[1:5], g[5]) for g in gaps] == [((0, len(data), len(plain[0]), len(plain[0]) + len(wrong)), "payload digest differs")]
    tail = gzip.compress(plain[0] + plain[1][:-9])
    assert kinds(tail + records()[5]) == [("record", b"p0" * 40), ("gap", None), ("record", b"p5" * 40)]


def test_cut_and_damaged_members_give_their_whole_records():
    rng = random.Random(5)
    parts = [warc.member(i, "u", "response", None, __import__("hashlib").sha256(p).hexdigest(), p) for i, p in enumerate(rng.randbytes(300) for _ in range(80))]
    data = packed(parts)
    assert len(salvaged(data)[0]) == 80 and salvaged(data)[1] == []
    assert len(salvaged(data[:-30])[0]) == 79 and kinds(data[:-30])[-1] == ("gap", None)
    assert len(salvaged(data[:-4] + b"zzzz" + parts[0])[0]) == 81  # a wrong trailer: digests vouch for the records
    half = bytearray(data)
    half[len(data) // 2] ^= 255
    found, gaps = salvaged(bytes(half) + parts[3])
    assert 30 <= len(found) <= 80 and gaps


def test_records_without_digest_need_a_whole_member():
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(bare * 2)
    assert len(salvaged(whole)[0]) == 2 and salvaged(whole[:-4] + b"zzzz") == ([], [(0, len(whole))])


def test_reading_is_linear():
    import time

    rng = random.Random(7)
    parts = [warc.member(i, "u", "response", None, __import__("hashlib").sha256(p).hexdigest(), p, 1) for i, p in enumerate(rng.randbytes(5000) for _ in range(4000))]
    took = []
    for n in (1000, 4000):
        data, began = b"".join(parts[:n]), time.process_time()
        assert sum(row[0] == "record" for row in warc.salvage(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 4 * 2.5 * took[0] + 0.2
