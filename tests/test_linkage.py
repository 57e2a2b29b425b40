"""The whole pipeline on generated business records with every odd row that readers and blocking must bear."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Config, enforce
from tessera.plans import linkage

FIRST = "Alpha Bright Cedar Delta Eagle Falcon Granite Harbor Indigo Jasper Kestrel Lumen Maple Nimbus Orchid Pioneer Quartz Raven Summit Tundra".split()
SECOND = "Foods Motors Textiles Software Logistics Bakery Pharma Printing Steel Toys".split()
STREETS = "Oak Elm Lake Hill Mill Park River Spring Sunset Valley".split()
HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry"


def noisy(name, rng):
    kind = rng.randrange(6)
    if kind == 0:
        return name.removesuffix(" Inc")
    if kind == 1:
        return " ".join(reversed(name.split()))
    if kind == 2:
        at = rng.randrange(1, len(name) - 1)
        return name[: at - 1] + name[at] + name[at - 1] + name[at + 1 :]
    return name.upper() if kind == 3 else name + " Group" if kind == 4 else name


def world(folder, split, seed, n):
    rng = random.Random(seed)
    s1, s2, s3, truth = [HEAD], [HEAD], [HEAD], ["source1_entity_id\tmatched_entity_ids"]
    for k in range(n):
        country = ["US", "India", "France"][k % 3] if k < n - 2 else "Peru"
        name, house = f"{rng.choice(FIRST)} {rng.choice(FIRST)} {rng.choice(SECOND)} Inc", rng.randint(1, 999)
        address = f"{house} {rng.choice(STREETS)} {rng.choice(STREETS)} Street, Town {rng.randint(1, 30)}"
        s1.append(f"S1-{split}{k}\t{name}\t{address}\t{country}")
        mine = []
        for src, rows in ((2, s2), (3, s3)):
            for j in range(rng.randint(0, 2)):
                i = f"S{src}-{split}{k}x{j}"
                rows.append(f"{i}\t{noisy(name, rng)}\t{address if rng.random() > 0.1 else ''}\t{country if rng.random() > 0.05 else ''}")
                mine.append(i)
        truth.append(f"S1-{split}{k}\t{','.join(mine)}")
        if rng.random() < 0.25:
            s2.append(f"S2-{split}d{k}\t{rng.choice(FIRST)} {rng.choice(SECOND)}\t{rng.randint(1, 99)} Other Road\t{country}")
    s1 += [f"S1-{split}0\tRepeated\tx\tUS", f"S1-{split}tab\tTab\tone\ttwo\tUS", f"S1-{split}short\tShort", f"S1-{split}dev\tपावर लिमिटेड\tदिल्ली\tIndia", f"S1-{split}inc\tInc\tNULL\tUS"]
    s3 += [s2[1], f"S3-{split}dom\tacme.com\t\tUS"]
    for name, rows in (("source1", s1), ("source2", s2), ("source3", s3), ("ground_truth", truth)):
        (folder / f"{split}_{name}.tsv").write_text("\n".join(rows) + "\n")
    return {r.split("\t")[0] for r in s1[1:]}


@pytest.mark.parametrize("seed", [7])
def test_fit_and_predict(spark, tmp_path, seed):
    world(tmp_path, "train", seed, 70)
    ids = world(tmp_path, "test", seed + 1, 40)
    config = Config(rounds=2, depth=3)
    report = linkage.train(spark, str(tmp_path), f"{tmp_path}/model", config)
    assert 0.5 < report["ALL"] <= 1
    checks = linkage.predict(spark, str(tmp_path), f"{tmp_path}/model", f"{tmp_path}/out", config).collect()
    assert {r["n"] for r in checks} == {0} and {r["list"] for r in checks} == {"matched", "candidates"}
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out/matched").glob("part-*"))).splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and {x.split("\t")[0] for x in lines[1:]} == ids and len(lines) == len(ids) + 1
    order = list(dict.fromkeys(r.split("\t")[0] for r in (tmp_path / "test_source1.tsv").read_text().splitlines()[1:]))
    assert [x.split("\t")[0] for x in lines[1:]] == order  # the source's order
    owned = [i for x in lines[1:] for i in x.split("\t")[1].split(",") if i]
    assert len(owned) == len(set(owned)) > 10


def test_features_and_contract(spark, tmp_path):
    ids = world(tmp_path, "train", 3, 30)
    with (tmp_path / "train_source1.tsv").open("a") as f:  # a query of no country meets rows of no country
        f.write("S1-blank\tQuark Bakery\t77 Oak Street\t\n")
    with (tmp_path / "train_source2.tsv").open("a") as f:
        f.write("S2-blank\tQuark Bakery\t77 Oak Street\t\nS2-us\tQuark Bakery\t77 Oak Street\tUS\n")
    rng = np.random.default_rng(1)
    named = [line.split("\t")[0] for k in (1, 2, 3) for line in (tmp_path / f"train_source{k}.tsv").read_text().splitlines()[1:]]
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    spark.createDataFrame([(i, unit(rng.normal(size=8))) for i in dict.fromkeys(named)], "id string, v array<float>").write.parquet(f"{tmp_path}/train_vectors.parquet")
    w = linkage.prepare(spark, str(tmp_path), "train")
    rows = linkage.featurise(w, linkage.block(w, Config()), Config())
    assert {r["i_id"] for r in rows.where("q_id = 'S1-blank'").collect()} & {"S2-blank", "S2-us"} == {"S2-blank"}
    assert rows.where("emb_cos is null").count() == 0 and rows.where("bit_dense = 1 and dense_cos is null or bit_dense = 0 and dense_cos is not null").count() == 0
    assert rows.where("bit_dense = 1").count() > len(ids)
    second = linkage.second_stage(rows.withColumn("p1", F.col("n_tset") / 2))
    assert set(linkage.STAGE2) <= set(second.columns) and second.where("c2t_n1 > 1 or c2t_n1 < 0").count() == 0
    assert len(linkage.STAGE1) == 72 and len(linkage.STAGE2) == 33 and set(linkage.STAGE1) <= set(rows.columns)
    doubles = [c for c, t in rows.dtypes if t == "double"]
    assert rows.where(" or ".join(f"isnan({c})" for c in doubles)).count() == 0
    assert rows.groupBy("q_id").agg(F.countDistinct("g_rank_combo").alias("r"), F.count("*").alias("n")).where("r <> n").count() == 0
    found = w.truth.join(rows, ["q_id", "i_id"], "left_semi").count() / w.truth.count()
    assert found > 0.9
    with pytest.raises(ValueError):
        enforce(Config().contract(["a"]), Config(), ["b"])
    assert enforce(Config(k_key=7).contract(["a"]), Config(), ["a"]).k_key == 7


def test_a_named_run_goes_on(spark, tmp_path, monkeypatch):
    from tessera import session as s

    monkeypatch.setattr(s, "shared_dir", lambda spark: str(tmp_path))
    rows = spark.range(3)
    assert s.finished(spark, None, "x") is None and s.finished(spark, "r", "x") is None
    assert s.kept(rows, "r", "x").count() == 3 and s.finished(spark, "r", "x").count() == 3
    (tmp_path / "run-r/x/_SUCCESS").unlink()
    assert s.finished(spark, "r", "x") is None and s.kept(rows, "r", "x").count() == 3
    scratch = s.written(rows, "y")
    assert scratch.count() == 3 and s.clear(spark) >= 1 and not list(tmp_path.glob("y-*"))
