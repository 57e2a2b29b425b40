import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, bm25, decision, dense, features, learning, metrics, sampling, tokens

PAIRS = "q_id long, i_id long, p double, y int"


def f_half(spark, tp, n, g):
    return spark.range(1).select(metrics.f_half(F.lit(tp), F.lit(n), F.lit(g))).first()[0]


def test_metric(spark):
    assert f_half(spark, 0, 0, 0) == 1 and f_half(spark, 0, 2, 0) == 0 and f_half(spark, 0, 0, 3) == 0
    assert f_half(spark, 2, 3, 2) == pytest.approx(0.714286, abs=1e-6)


def test_truth_scores_one(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 1), (2, 3, 0.7, 1)], PAIRS)
    entities = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "b", 0)], "q_id long, segment string, truth long")
    got = {r["segment"]: r["macro_f05"] for r in metrics.macro_f05(metrics.entity_counts(entities, pairs)).collect()}
    assert got == {"a": 1.0, "b": 1.0, "ALL": 1.0}


def test_one_owner_ties_go_to_the_lower_query(spark):
    pairs = spark.createDataFrame([(2, 7, 0.5, 0), (1, 7, 0.5, 1), (3, 8, 0.1, 0)], PAIRS)
    assert sorted((r["q_id"], r["i_id"]) for r in decision.one_owner(pairs).collect()) == [(1, 7), (3, 8)]


def brute_prefix(ps, tau, gamma, miss):
    ps = sorted(ps, reverse=True)
    total, cum, best, cut = sum(ps), 0.0, -1.0, 0
    for k, p in enumerate(ps, 1):
        cum += p
        ef = -1 if p < tau else 1.25 * cum / (0.25 * (total + miss) + k)
        if ef > best:
            best, cut = ef, k
    empty = gamma * float(np.prod([1 - min(p, 1 - 1e-7) for p in ps]))
    return cut if best > empty and best > 0 else 0


def test_expected_f_prefix_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    lists = {q: [round(float(p), 3) for p in rng.random(rng.integers(1, 6)) ** 2] for q in range(80)}
    pairs = spark.createDataFrame([(q, i, p, 0) for q, ps in lists.items() for i, p in enumerate(ps)], PAIRS)
    got = {r["q_id"]: r["n"] for r in decision.expected_f_prefix(pairs, 0.2, 0.85, 0.1).groupBy("q_id").agg(F.count("*").alias("n")).collect()}
    assert got == {q: n for q, ps in lists.items() if (n := brute_prefix(ps, 0.2, 0.85, 0.1))}


def test_proximity(spark):
    rows = [(0.5, 10, 10), (0.5, 10, 13), (0.5, 10, 30), (0.5, None, 3), (0.99, 1, 1), (0.01, 1, 2)]
    df = spark.createDataFrame(rows, "p double, a int, b int")
    got = [round(r[0], 6) for r in df.select(decision.proximity_adjusted(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.55, 0.45, 0.5, 0.5, 1.0, 0.0]


def test_same_selection_whatever_the_partitions(spark):
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(int(a), int(b), round(float(p), 1), 0) for a, b, p in zip(rng.integers(0, 40, 600), rng.integers(0, 90, 600), rng.random(600))], PAIRS).dropDuplicates(["q_id", "i_id"])
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.createDataFrame(pairs.collect(), PAIRS)
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, decision.expected_f_prefix(decision.one_owner(rows)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_folds_are_zlib(spark):
    got = spark.range(200).select("id", sampling.crc_fold(F.col("id").cast("string"), 10, "s").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(f"s{r['id']}".encode()) % 10 for r in got)


def test_sub_world(spark):
    q, i = spark.range(300).withColumnRenamed("id", "q_id"), spark.range(900).withColumnRenamed("id", "i_id")
    owners = i.where("i_id < 600").select("i_id", (F.col("i_id") % 300).alias("q_id"))
    kept, index = sampling.sub_world(q, i, owners, 0.3)
    ids = {r[0] for r in kept.collect()}
    assert ids == {k for k in range(300) if zlib.crc32(f"dev{k}".encode()) % 1000 < 300}
    want = {k for k in range(600) if k % 300 in ids} | {k for k in range(600, 900) if zlib.crc32(f"devx{k}".encode()) % 1000 < 300}
    assert {r[0] for r in index.collect()} == want


def test_samples(spark):
    rows = spark.range(100).select(F.col("id").alias("q_id"), F.col("id").alias("i_id"), (F.col("id") / 100).alias("p"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    hard = sampling.hard_negatives(rows, F.col("p"), 5).collect()
    assert sorted(r["q_id"] for r in hard if not r["y"]) == [95, 96, 97, 98, 99] and sum(r["y"] for r in hard) == 10
    assert sampling.weighted_sample(rows, F.col("p"), F.col("q_id"), 7).count() == 7
    assert [r["x"] for r in sampling.first_wins(spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("", 0, "none")], "k string, pos int, x string"), "k", "pos").collect()] == ["first"]


def test_blank_partitions_join_without_a_nested_loop(spark):
    rows = spark.createDataFrame([("r1", "us"), ("r2", "")], "id string, ckey string")
    parts = spark.createDataFrame([("us",), ("in",), ("",)], "ckey string")
    out = blocking.replicated(rows, parts)
    assert sorted(map(tuple, out.collect())) == [("r1", "us"), ("r2", ""), ("r2", "in"), ("r2", "us")]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_rarest_tokens_break_ties_by_text(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (4, "c")], "rec long, tok string")
    got = tokens.rarest_tokens(rows, tokens.document_frequency(rows), 2, "rec").where("rec = 1").orderBy("rk").collect()
    assert [r["tok"] for r in got] == ["a", "b"]


def test_merge_keeps_scores_and_joins_bits(spark):
    a = spark.createDataFrame([(1, 1, 2.0, 1, 1)], "q_id long, i_id long, score double, bits int, rk int")
    b = spark.createDataFrame([(1, 1), (1, 2)], "q_id long, i_id long")
    assert sorted(map(tuple, blocking.merged(a, b, "BM25", 40).collect())) == [(1, 1, 2.0, 257, 1), (1, 2, 0.0, 256, 90)]


def test_dense_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[30:40] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)], "id long, part int, v array<double>")
    got = {(r["q_id"], r["rk"]): r["i_id"] for r in dense.top_k(df.where("id < 20"), df.where("id >= 20"), 5).collect()}
    for q in range(20):
        own = [i for i in range(20, 60) if i % 2 == q % 2]
        best = sorted(own, key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:5]
        assert [got[q, k + 1] for k in range(5)] == best
    monkeypatch.setattr(dense, "HELD", 3)
    again = dense.top_k(df.where("id % 10 = 0"), df, 4, exclude_self=True).collect()
    for q in range(0, 60, 10):
        best = sorted((i for i in range(60) if i % 2 == q % 2 and i != q), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:4]
        assert [r["i_id"] for r in sorted(again, key=lambda r: r["rk"]) if r["q_id"] == q] == best


def test_grid_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    lists = {q: sorted(((round(float(p), 2), int(rng.random() < p)) for p in rng.random(rng.integers(0, 6))), reverse=True) for q in range(60)}
    pairs = spark.createDataFrame([(q, i, p, y) for q, ps in lists.items() for i, (p, y) in enumerate(ps)], PAIRS)
    truth = {q: sum(y for _, y in ps) + (q % 7 == 0) for q, ps in lists.items()}
    entities = spark.createDataFrame(list(truth.items()), "q_id long, truth long")
    f = lambda tp, n, g: float(n == 0) if g == 0 else 0.0 if n == 0 else 1.25 * tp / (0.25 * g + n)
    want = []
    for t in decision.THRESHOLDS:
        want.append(np.mean([f(sum(y for p, y in ps if p >= t), sum(p >= t for p, _ in ps), truth[q]) for q, ps in lists.items()]))
    for t in decision.TAUS:
        for g in decision.GAMMAS:
            for m in decision.MISSES:
                cuts = {q: brute_prefix([p for p, _ in ps], t, g, m) if ps else 0 for q, ps in lists.items()}
                want.append(np.mean([f(sum(y for _, y in ps[: cuts[q]]), cuts[q], truth[q]) for q, ps in lists.items()]))
    got = decision.grid_scores(pairs, entities).orderBy("point").collect()
    assert [r["point"] for r in got] == list(range(325)) and np.allclose([r["macro_f05"] for r in got], want, atol=2e-6)
    assert decision.grid_best(pairs, entities).first()["point"] == int(np.argmax(np.round(want, 6)))


def test_bm25_and_attributes_by_partition(spark):
    """A partition's figures are those it has alone."""
    rng = np.random.default_rng(6)
    rows = [(p, i, [f"t{rng.integers(0, 9)}" for _ in range(rng.integers(1, 8))]) for p in ("a", "b") for i in range(40)]
    index = spark.createDataFrame([(p, f"{p}{i}", t) for p, i, t in rows], "ckey string, i_id string, toks array<string>")
    query = spark.createDataFrame([(p, f"q{p}{i}", t[:3]) for p, i, t in rows[::9]], "ckey string, q_id string, toks array<string>")
    both = sorted(map(tuple, bm25.top_k(query, index, 5, floor=20, part=("ckey",)).collect()))
    alone = [r for p in ("a", "b") for r in bm25.top_k(query.where(F.col("ckey") == p), index.where(F.col("ckey") == p), 5, floor=20).collect()]
    assert both == sorted(map(tuple, alone)) and both
    records = index.select("ckey", F.col("i_id").alias("id"), (F.length("i_id") % 2 + 1).alias("src"), F.array_join("toks", " ").alias("n_core"), F.array_join(F.slice("toks", 1, 2), " ").alias("a_full"))
    key = lambda r: (r["id"], r["name_df_s1"], r["name_df_idx"], sorted((t, round(w / sum(x * x for x in r["n_cos_char_w"]) ** 0.5, 9)) for t, w in zip(r["n_cos_char_t"], r["n_cos_char_w"])))
    whole = sorted(key(r) for r in features.attributes(records).collect())
    assert whole == sorted(key(r) for p in ("a", "b") for r in features.attributes(records.where(F.col("ckey") == p)).collect()) and len(whole) == 80


def test_string_features_equal_plain_functions(spark):
    from tessera.functions import similarity as sim

    rng = np.random.default_rng(2)
    pool = ["acme foods", "foods acme", "acme fods", "", "zeta & co", "acme foods market", "a b c", "x" * 250 + " y"]
    parts = ["n_core", "n_full", "n_concat", "n_skel", "n_phon", "n_alt_a", "n_alt_b", "a_full", "a_core", "a_alpha", "a_skel"]
    vectors = [f"{v}_{x} array<{'string' if x == 't' else 'double'}>" for v in features.VECTORS for x in "tw"]
    some = lambda: [x for _ in features.VECTORS for t in [[f"t{k}" for k in range(6) if rng.random() < 0.5]] for x in (t, [float(rng.random()) + 0.1 for _ in t])]
    record = {k: ([str(rng.choice(pool)) for _ in parts], some()) for k in range(24)}
    data = [(f"q{a}", f"i{b}", int(rng.integers(0, 2)), *record[a][0], *record[b][0], *record[a][1], *record[b][1]) for a, b in rng.integers(0, 24, (90, 2)).tolist()]
    schema = ", ".join(["q_id string", "i_id string", "open int", *(f"{s}_{p} string" for s in "qi" for p in parts), *(f"{s}_{v}" for s in "qi" for v in vectors)])
    got = features.string_features(spark.createDataFrame(data, schema), F.col("open") == 1).collect()
    plain = {"n_ratio": (sim.ratio, "n_core"), "n_pratio": (sim.partial_ratio, "n_core"), "n_tsort": (sim.token_sort_ratio, "n_core"), "n_tset": (sim.token_set_ratio, "n_core"), "n_jw": (sim.jaro_winkler_score, "n_core"), "n_skel_ratio": (sim.token_sort_ratio, "n_skel"), "n_phon_ratio": (sim.token_set_ratio, "n_phon"), "a_pratio": (sim.partial_ratio, "a_full"), "a_core_tset": (sim.token_set_ratio, "a_core")}
    assert len(got) == 90
    for r, row in zip(sorted(got, key=lambda r: (r["q_id"], r["i_id"])), sorted(data)):
        for name, (f, part) in plain.items():
            lead = "n_core" if name[0] == "n" else "a_full"
            x, y = r[f"q_{part}"][:200], r[f"i_{part}"][:200]
            want = None if not r["open"] or not r[f"q_{lead}"] or not r[f"i_{lead}"] else 1.0 if x == y else f(x, y)
            assert r[name] is want or abs(r[name] - want) < 1e-9, (name, x, y)
        at = 3 + 2 * len(parts)
        unit = lambda t, w: {k: x / sum(v * v for v in w) ** 0.5 for k, x in zip(t, w)}
        a, b = unit(*row[at : at + 2]), unit(*row[at + 6 : at + 8])
        assert abs(r["n_cos_char"] - sum(w * b.get(k, 0) for k, w in a.items())) < 1e-9


def test_compound_keys_equal_plain_loops(spark):
    """All seven families."""
    from collections import Counter

    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 12, rng.integers(0, n))]
    records = [("ab"[k % 2], k, "qi"[k % 3 > 0], word(6), word(6), word(5), word(5), word(5), [str(x) for x in rng.integers(0, 5, rng.integers(0, 4))], "".join(word(2))) for k in range(80)]
    fields = ["ckey", "id", "side", "core", "alpha", "skel", "askel", "phon", "nums", "concat"]
    df = spark.createDataFrame(records, "ckey string, id long, side string, core array<string>, alpha array<string>, skel array<string>, askel array<string>, phon array<string>, nums array<string>, concat string")
    rows = [dict(zip(fields, r)) for r in records]
    df_of = {f: Counter((r["ckey"], t) for r in rows for t in set(r[f])) for f in ("core", "alpha", "skel", "askel", "phon")}
    want = set()
    for r in rows:
        rare = lambda f, k, r=r: sorted((t for t in set(r[f]) if df_of[f][r["ckey"], t] >= 2), key=lambda t: (df_of[f][r["ckey"], t], t))[:k]
        cross = {"NT": (rare("core", 2), rare("alpha", 4)), "NS": (rare("skel", 2), rare("askel", 3)), "AN": (r["nums"][:2], rare("alpha", 3)), "NH": (rare("core", 2), r["nums"][:2]), "PH": (rare("phon", 2), rare("askel", 3))}
        keys = {(f, a, b) for f, (x, y) in cross.items() for a in x for b in y}
        keys |= {("NP", a, b) for a in rare("core", 3) for b in rare("core", 3) if a < b} | ({("NC", r["concat"], "")} if r["concat"] else set())
        want |= {(r["ckey"], r["id"], r["side"], *k) for k in keys}
    got = {tuple(r) for r in blocking.compound_keys(df).collect()}
    assert got == want and len({k[3] for k in got}) == 7


def test_keep_by_rank(spark):
    df = spark.createDataFrame([(k, k % 2 == 0) for k in range(1, 11)], "rk int, flag boolean")
    assert [r["rk"] for r in bm25.keep_by_rank(df, "flag", 3, 8).collect()] == [1, 2, 3, 4, 6, 8]


def test_isotonic_pools_violators(spark):
    train = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "p double, y int")
    rows = spark.createDataFrame([(0.0,), (0.25,), (0.9,)], "p double")
    assert [round(r["p_cal"], 6) for r in learning.calibrated(train, rows).orderBy("p").collect()] == [0.0, 0.5, 1.0]


def test_context_missing_scores_are_null(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, None, 0), (2, 1, 0.4, 0)], PAIRS)
    got = {(r["q_id"], r["i_id"]): r for r in decision.context(pairs).collect()}
    assert got[1, 1]["g_second"] is None and got[1, 2]["g_rank"] == 2 and got[1, 1]["i_max_other"] == 0.4 and got[2, 1]["i_max_other"] == 0.9


def test_tfidf_rows_are_normalised(spark):
    w = features.tfidf(spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "d long, t array<string>"), "d", "t")
    assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("d").agg(F.sum(F.col("w") ** 2).alias("s")).collect())


def test_words_and_skeletons_outside_of_spark(spark):
    """The kernels' words are those of the native expressions."""
    from tessera.functions import text as T
    from tessera.plans.fixtures import folded_tokens, folded_words

    texts = ["Ångström \u212bb \u212aelvin İstanbul STRAẞE Straße", "Photography shchool 2024 00x ghh", "", "naïve façade — ÑANDÚ ŸES œuvre", None, "a aa aaa bbookkeeper mmzz wwqq 7 xyzzy ΣΑΣ thhe", "e\u0301te\nligne\tdeux"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("w", folded_tokens(F.col("t")))
    for r in rows.select("k", "w", F.transform("w", T.skeleton).alias("s")).collect():
        assert folded_words(texts[r["k"]]) == r["w"] and [T.skeleton_of(w) for w in r["w"]] == r["s"]


@pytest.mark.parametrize("most", [0, 6, 1000])
def test_rarest_whatever_is_frequent(spark, monkeypatch, most):
    """Records' rarest tokens, with none, some and all frequencies known to the tasks; known tokens beyond the k rarest of
    a record make no row."""
    from collections import Counter

    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], k, [f"w{int(x)}" for x in rng.zipf(1.3, 14) if x < 60], [f"w{int(x)}" for x in rng.integers(0, 9, 5)]) for k in range(60)]
    records = spark.createDataFrame(rows, "ckey string, id long, core array<string>, alpha array<string>")
    count = [Counter((r[0], t) for r in rows for t in set(r[c])) for c in (2, 3)]
    monkeypatch.setattr(tokens, "MOST_FREQUENT", most)
    want = {r[1]: tuple(sorted((t for t in set(r[2 + c]) if count[c][r[0], t] > 1), key=lambda t, c=c, r=r: (count[c][r[0], t], t))[:k] for c, k in ((0, 2), (1, 4))) for r in rows}
    assert {r["id"]: (r["core"], r["alpha"]) for r in blocking.rarest(records, {"core": 2, "alpha": 4}, ["ckey", "id"]).collect()} == want
    df = tokens.frequencies(records, "ckey", words := tokens.of_arrays(("core", "alpha")))
    assert {(r["family"], r["ckey"], r["tok"]): r["df"] for r in df.collect()} == {(f, *k): n for f, c in zip(("core", "alpha"), count) for k, n in c.items() if n > 1}
    known = tokens.frequent(df, most)
    assert sum(map(len, known.values())) <= most
    made = Counter((r["id"], r["family"]) for r in tokens.contenders(records, ["ckey", "id"], words, {"core": 2, "alpha": 4}, known).collect())
    assert most < 1000 or max(n for (_, f), n in made.items() if f == "alpha") <= 4 and max(made[r[1], "core"] - sum(count[0][r[0], t] < 2 for t in set(r[2])) for r in rows) <= 2


@pytest.mark.parametrize("most", [0, 20, 10_000])
def test_cosines_of_texts_equal_those_of_term_rows(spark, monkeypatch, most):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"{'aeiou'[x % 5]}{x}" for x in rng.zipf(1.4, n) if x < 300)
    everyone = spark.createDataFrame([("ab"[k % 2], k, text(int(rng.integers(0, 12))), text(int(rng.integers(0, 12))) if k % 5 else "") for k in range(40)], "ckey string, id long, n_core string, a_full string")
    named = [("ab"[k % 2], k, j) for k in range(0, 12) for j in range(k % 2, 24, 2) if j != k]
    side = lambda s: everyone.select("ckey", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "n_core", "a_full")))
    pairs = spark.createDataFrame(named, "ckey string, q_id long, i_id long").join(side("q"), ["ckey", "q_id"]).join(side("i"), ["ckey", "i_id"])
    monkeypatch.setattr(tokens, "MOST_FREQUENT", most)
    got = {(r["q_id"], r["i_id"]): r for r in features.with_cosines(pairs, everyone.where("id < 24"), everyone).collect()}
    assert len(got) == len(named)
    own = {r["id"]: r for r in features.attributes(everyone.withColumn("src", F.lit(1))).collect()}
    for (q, i), r in got.items():
        for v in features.VECTORS:
            x, y = (dict(zip(own[k][f"{v}_t"] or (), own[k][f"{v}_w"] or ())) for k in (q, i))
            size = sum(w * w for w in x.values()) ** 0.5 * sum(w * w for w in y.values()) ** 0.5
            assert abs(r[v] - (sum(w * y.get(t, 0) for t, w in x.items()) / size if size else 0)) < 1e-9


def test_features_asked_for_are_those_of_all(spark):
    """The classifier's few features, made alone, are the ones that pair_features has; skeletons and codes that string scorers
    can't see change nothing."""
    from tessera.plans import learning as plans

    folder, few = "/root/testdata/sf0.01", ["n_tset", "n_cos_word", "n_jacc", "n_ntok_diff", "a_tset", "a_num_jacc", "bscore", "brank", "b_ntypes"]
    both = [sorted(map(tuple, out.select("q_id", "i_id", "y", *(F.round(c, 6).alias(c) for c in few)).collect())) for out in (plans.featured(spark, folder, ("n_tset", "a_tset"), ("n_cos_word",), names=False), plans.featured(spark, folder))]
    assert both[0] == both[1] and len(both[0]) == 85


def test_codes_and_skeletons_of_the_words_that_are_seen(spark):
    from tessera.functions import text as T
    from tessera.plans.learning import SEEN_WORDS

    rows = spark.createDataFrame([(" ".join(f"{'abcdeghk'[k % 8]}{'h' * (k % 3)}" for k in range(300)),), ("photographer night " * 150,), ("Élan 12 " * 90,)], "t string")
    out = T.with_name(rows, "t").select("t", "n_core", F.col("n_skel").alias("all")).join(T.with_name(rows, "t", skeletons=SEEN_WORDS).select("t", F.col("n_skel").alias("some")), "t")
    for r in out.withColumn("code", T.nysiis_words("n_core")).withColumn("cut", T.nysiis_words(F.array_join(F.slice(F.split("n_core", " "), 1, SEEN_WORDS), " "))).collect():
        assert r["all"][: features.SCORED_CHARS] == r["some"][: features.SCORED_CHARS] and r["code"][: features.SCORED_CHARS] == r["cut"][: features.SCORED_CHARS]


def test_pair_features_score_whole_texts(spark, tmp_path):
    """Names and addresses that are equal for their first 200 characters and differ after them."""
    from tessera.functions import similarity as sim
    from tessera.functions import text as T
    from tessera.plans import learning as plans

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), 6))
    lead, other = ([word() for _ in range(60)] for _ in range(2))
    half = lambda first: first + [word() for _ in range(60)]
    docs = [(k, " ".join(half(lead) + half(other)), "en") for k in range(6)]
    assert all(len(" ".join(x)) > 2 * features.SCORED_CHARS for x in (lead, other))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.featured(spark, str(tmp_path)).collect()
    plain = {"n_ratio": (sim.ratio, "n_core"), "n_pratio": (sim.partial_ratio, "n_core"), "n_tsort": (sim.token_sort_ratio, "n_core"), "n_tset": (sim.token_set_ratio, "n_core"), "n_jw": (sim.jaro_winkler_score, "n_core"), "n_lev_full": (sim.levenshtein_score, "n_full"), "n_tset_full": (sim.token_set_ratio, "n_full"), "n_concat_ratio": (sim.ratio, "n_concat"), "n_concat_pratio": (sim.partial_ratio, "n_concat"), "n_skel_ratio": (sim.token_sort_ratio, "n_skel"), "n_phon_ratio": (sim.token_set_ratio, "n_phon"), "a_ratio": (sim.ratio, "a_full"), "a_tsort": (sim.token_sort_ratio, "a_full"), "a_tset": (sim.token_set_ratio, "a_full"), "a_pratio": (sim.partial_ratio, "a_full"), "a_core_tset": (sim.token_set_ratio, "a_core"), "a_alpha_tset": (sim.token_set_ratio, "a_alpha"), "a_skel_ratio": (sim.token_set_ratio, "a_skel")}
    assert len(rows) == 8
    for r in rows:
        parts = [{p: r[f"{s}_{p}"] for p in ("n_core", "n_skel", "a_full", "a_alpha", "a_skel")} for s in "qi"]
        for own in parts:
            own |= {"n_full": own["n_core"], "n_concat": own["n_core"].replace(" ", ""), "n_phon": T.nysiis_codes(own["n_core"]), "a_core": own["a_full"]}
            assert len(own["n_skel"].split()) == len(own["a_skel"].split()) == len(own["n_core"].split()) == 120
        for name, (f, part) in plain.items():
            x, y = parts[0][part], parts[1][part]
            assert x[: features.SCORED_CHARS] == y[: features.SCORED_CHARS] and len(x) > features.SCORED_CHARS
            assert r[name] == pytest.approx(f(x, y), abs=1e-9) and r[name] < 1, name
        assert r["n_alias_best"] == r["n_tset"] < 1


def test_lean_records_score_as_whole_ones(spark):
    from tessera.functions import text as T

    texts = ["acme foods ltd", "acme fods aka zeta co", "", "zeta & co", "zeta formerly acme foods inc", "12 near mill road, pune", "élan gmbh 7"]
    own = T.with_address(T.with_name(spark.createDataFrame([(k, t, texts[-1 - k]) for k, t in enumerate(texts)], "id int, n string, a string"), "n"), "a", F.lit("")).drop("n", "a").withColumn("n_phon", T.nysiis_words("n_core"))
    got = []
    for records in (own, features.lean(own)):
        side = lambda s, records=records: records.select(*(F.col(c).alias(f"{s}_{c}") for c in records.columns))
        out = features.string_features(side("q").crossJoin(side("i")), F.lit(True), chars=None)
        got.append(sorted((r["q_id"], r["i_id"], *(r[n] for n in features.BASE if n in out.columns)) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 49 and len({r[2:] for r in got[0]}) > 20


def test_an_id_of_two_texts_has_each_ones_names(spark, tmp_path):
    from tessera.plans import learning as plans

    a, b = "alpha bravo charlie delta echo foxtrot golf hotel", "india juliet kilo lima alpha november oscar papa"
    docs = [(0, a), (0, b), (1, a), (3, a), (4, b)]
    spark.createDataFrame([(k, t, "en") for k, t in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.featured(spark, str(tmp_path)).collect()
    assert rows and {(r["q_n_core"], r["q_name_df_s1"]) for r in rows if r["q_id"] == 0} == {("alpha bravo charlie delta", 2), ("india juliet kilo lima", 1)}
    assert len(rows) == len({(r["q_id"], r["q_n_core"], r["i_id"]) for r in rows})
