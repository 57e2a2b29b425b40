import random

import numpy as np

from tessera.llm import decontam

from .helpers import docs, rows, saved


def distance(item, run):
    col, best = list(range(len(item) + 1)), len(item)
    for c in run:
        last, col = col, [0]
        for i in range(1, len(item) + 1):
            col.append(min(last[i] + 1, col[i - 1] + 1, last[i - 1] + (item[i - 1] != c)))
        best = min(best, col[-1])
    return best


def world(seed, count=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 50)))) for k in range(20)]
    texts = []
    for d in range(count):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        if d % 2:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, int(0.3 * len(item)))):
                at, kind = rng.randrange(len(item)), rng.randrange(3)
                item[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(vocabulary)]
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append((d, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in words)))
    return items, texts


def test_recall_and_exactness_against_brute_force(spark):
    items, texts = world(1, 160)
    want = {(d, i) for d, t in texts for i, p in items if distance(decontam.words(p), decontam.words(t)) <= decontam.allowed(len(decontam.words(p)))}
    schema = "item_id long, text string"
    got = decontam.contaminated(docs(spark, texts), spark.createDataFrame(items, schema)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 40
    by_item, by_doc = dict(items), dict(texts)
    for r in got:
        assert r["edits"] == distance(decontam.words(by_item[r["item_id"]]), decontam.words(by_doc[r["doc_id"]]))
    clean = decontam.clean(docs(spark, texts), spark.createDataFrame(items, schema))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in found}


def test_blocks_find_the_same(spark, monkeypatch):
    items, texts = world(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = rows(decontam.contaminated(docs(spark, texts), bench))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    assert len(decontam.blocks(bench)) > 3
    assert [r[:3] for r in rows(decontam.contaminated(docs(spark, texts), bench))] == [r[:3] for r in one]


def test_alignment_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(1500):
        p, q = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        assert decontam.best_alignment(p, np.array(q, np.int64))[0] == distance(p, q)


def test_query_on_edges(spark, tmp_path):
    item = "The quick, brown fox jumps over the lazy dog and runs far away today"
    long = "filler " * 100_000 + item.upper() + " end" * 100_000
    data = [(1, None), (2, ""), (3, item), (3, item), (4, long), (5, "clean words only"), (None, "x " + item), (6, "Hi")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (None, item), (4, ""), (5, "hi!"), (6, "...")], "item_id long, text string")
    path = saved(tmp_path, documents=docs(spark, data, extra=True), benchmark=bench)
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.op5_decontamination(spark, path).collect()}
    assert got == {(d, i, 0) for d in (3, 4, None) for i in (1, 2)} | {(6, 5, 0)}
    empty = saved(tmp_path / "e", documents=docs(spark, []), benchmark=bench.where("false"))
    assert rows(decontam.op5_decontamination(spark, empty)) == []
    assert decontam.clean(docs(spark, data), bench.where("false")).count() == len(data)


def test_items_of_one_and_two_words_inside_longer_texts(spark):
    texts = [(1, "they said hi again"), (2, "Hi"), (3, "hi hi"), (4, "his hiss"), (5, "well, oh no! HI"), (6, "no oh"), (7, "")]
    items = [(1, "hi!"), (2, "oh no"), (3, "Hi"), (4, "a much longer item that no text holds at all")]
    for kept in (items, items[:1]):
        got = decontam.contaminated(docs(spark, texts), spark.createDataFrame(kept, "item_id long, text string"))
        want = [(d, i, 0, 1, at, at + 1) for d, at in ((1, 2), (2, 0), (3, 0), (5, 3)) for i in (1, 3)] + [(5, 2, 0, 2, 1, 3)]
        assert rows(got) == sorted((w for w in want if w[1] in dict(kept)), key=repr)


def mutants(rng, items, fresh):
    """A text around each item with the most edits allowed."""
    out = []
    for i, t in items:
        w = t.split()
        for _ in range(decontam.allowed(len(w))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(fresh)]
        out.append((i, " ".join(rng.choices(fresh, k=20) + w + rng.choices(fresh, k=20))))
    return out


def test_long_items_are_found_though_low_ids_are_short():
    rng = random.Random(4)
    vocabulary, fresh = [f"v{i}" for i in range(3000)], [f"f{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=15 if k < 64 else 400))) for k in range(104)]
    texts = mutants(rng, items[64:], fresh)
    found = {(texts[d][0], i) for d, i, *_ in decontam.Index(items).matches([t for _, t in texts])}
    assert {(i, i) for i, _ in texts} <= found


def test_lengths_beyond_the_most_tables_are_verified_exactly(monkeypatch):
    items, texts = world(5, 80)
    want = {(d, i) for d, t in texts for i, p in items if distance(decontam.words(p), decontam.words(t)) <= decontam.allowed(len(decontam.words(p)))}
    monkeypatch.setattr(decontam, "MOST_TABLES", 0)
    index = decontam.Index(items)
    assert {(d, i) for d, i, *_ in index.matches([t for _, t in texts])} == want and len(want) > 20
    many = " ".join(("  ".join(items[0][1].split()[:k]) for k in range(1, 9))) + " " + items[0][1] + " x" * 9 + items[0][1]
    assert index.matches([many])[0][1:3] == (0, 0)
