import random
import re

import pytest

from tessera.llm import ngram_join

from .helpers import docs, rows, saved


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(data):
    """Rows without an id aren't nodes."""
    sets = {i: shingles(t) for i, t in data if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i)) for i in sets), key=repr)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, bases = text(30), [text(rng.choice([4, 6, 7, 8, 40, 90, 150])) for _ in range(14)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            words = list(rng.choice(bases[: 4 if kind < 0.3 else 14]))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.8:
            words = passage + text(rng.randint(0, 12))
        else:
            words = text(rng.randint(0, 60))
        out.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize(("seed", "frequent", "short", "combined"), [(1, 32, 32, 64), (2, 3, 3, 64), (3, 2, 2, 10_000), (4, 4, 2, 0), (5, 6, 4, 60)])
def test_equals_brute_force_whatever_the_classes(spark, monkeypatch, seed, frequent, short, combined):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "COMBINED", combined)
    data = corpus(seed)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows(ngram_join.near_duplicates(df)) == brute(data)


def test_a_bounded_frequent_class_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 5)
    data = corpus(6)
    assert rows(ngram_join.near_duplicates(docs(spark, data))) == brute(data)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1)
    data = corpus(7)
    assert rows(ngram_join.near_duplicates(docs(spark, data))) == brute(data)


def test_query_on_edges(spark, tmp_path):
    long = " ".join(f"x{i}" for i in range(120_000))
    data = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (9, "ONE  two"), (10, "one two three"), (11, long), (12, long + " y"), (13, "É a b c d"), (14, "é a b c d"), (None, "one two"), (None, "nobody else")]
    got = rows(ngram_join.op7_ngram_jaccard_join(spark, saved(tmp_path, documents=docs(spark, data, extra=True))))
    want = brute(data) + [(9, 1, 8), (None, 1, 8), (None, 1, None)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [11, 12])
def test_ids_that_name_several_texts(spark, seed):
    """Each row counts by its own text, whatever else its id names."""
    rng = random.Random(seed)
    data = [(i if rng.random() < 0.5 else rng.randrange(0, 40), t) for i, t in corpus(seed, 120)] + [(3, None), (3, "a b"), (-5, "a b")]
    data += rng.sample(data, 30)
    got = rows(ngram_join.near_duplicates(docs(spark, data)))
    nodes = {}  # set -> smallest id
    for i, t in data:
        if shingles(t):
            nodes[shingles(t)] = min(i, nodes.get(shingles(t), i))
    keys = list(nodes)
    apart = brute_sets(keys)
    least = {}
    for k, c in zip(keys, apart):
        least[c] = min(least.get(c, nodes[k]), nodes[k])
    place = dict(zip(keys, apart))
    assert got == sorted(((i, len(shingles(t)), least[place[shingles(t)]] if shingles(t) else i) for i, t in data), key=repr)


def brute_sets(keys):
    """A component's number for each set."""
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            both = len(keys[a] & keys[b])
            if both and 100 * both >= 75 * len(keys[a] | keys[b]):
                up[find(a)] = find(b)
    return [find(i) for i in range(len(keys))]


def test_empty_table(spark, tmp_path):
    assert rows(ngram_join.op7_ngram_jaccard_join(spark, saved(tmp_path, documents=docs(spark, [])))) == []


def test_components_of_a_long_chain(spark):
    from tessera.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 900), (900, 500), (None, 3)]
    got = rows(components(spark.createDataFrame(edges, "x long, y long")))
    assert got == sorted([(i, 0) for i in range(301)] + [(500, 500), (900, 500)], key=repr)
