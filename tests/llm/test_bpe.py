import hashlib
import random

import pytest
import tiktoken

from tessera.llm import bpe

from .helpers import docs, rows, saved

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def tiny():
    return bpe.Codec(PATH, PATTERN, leaf_chars=5, leaf_bytes=2)


@pytest.fixture(scope="module")
def library():
    """The library, which takes no part in the operator."""
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).ranks, special_tokens={})


def test_tree_equals_library_on_random_texts(tiny, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("aab 'stredl  \n\t19.é!中\x1c\x85　’") for _ in range(rng.randint(0, 80)))
        want = library.encode_ordinary(text)
        assert tiny.encode(text) == bpe.codec(PATH, PATTERN).encode(text) == want
        assert tiny.decode(want) == text.encode()


def test_both_merges_equal_the_plain_one(tiny):
    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((tiny.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [tiny.ranks[p] for p in parts]

    rng = random.Random(2)
    for _ in range(1500):
        data = bytes(rng.choice(b"aaabestindre \xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert tiny.merge(data) == tiny.merge_by_heap([tiny.byte_ids[b] for b in data]) == plain(data)


def test_ordinary_texts_go_through_the_tree(library):
    """Texts and pieces of sf0.01 are joined from halves, and equal the library's."""
    import pyarrow.parquet as pq

    codec, calls = bpe.Codec(PATH, PATTERN), {"join_pieces": 0, "join_tokens": 0}
    for name in calls:
        def counted(*a, name=name, f=getattr(codec, name)):
            calls[name] += 1
            return f(*a)

        setattr(codec, name, counted)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    for text in texts:
        assert codec.encode(text) == library.encode_ordinary(text)
    assert calls["join_pieces"] > len(texts) and calls["join_tokens"] > 100, calls
    assert not any("tiktoken" in type(v).__module__ for v in vars(codec).values()) and "tiktoken" not in vars(bpe)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 999, "é" * 1000, "thingtion" * 900, "x" * 99_999 + " y"])
def test_long_pieces(tiny, library, text):
    assert tiny.encode(text) == bpe.codec(PATH, PATTERN).encode(text) == library.encode_ordinary(text)


def test_query_on_edges(spark, tmp_path, library):
    data = docs(spark, [(1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world"), (None, "a"), (4, "word " * 60_000)], extra=True)
    want = []
    for r in data.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows(bpe.op3_byte_bpe(spark, saved(tmp_path, documents=data))) == sorted(want, key=repr)


def test_empty_table_and_ids(spark):
    assert rows(bpe.round_trip(docs(spark, []), PATH, PATTERN)) == []
    coded = bpe.encode(docs(spark, [(1, "naïve café"), (2, None)]), PATH, PATTERN)
    assert rows(bpe.decode(coded, PATH, PATTERN)) == [(1, bytearray("naïve café".encode())), (2, bytearray())]
