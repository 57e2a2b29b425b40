"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are 5-word shingles. They have one global order, rare before frequent, and two classes. A document
of n tokens can differ from a partner in at most t = n - ceil(0.75 n) of its own. It indexes

* each token of its prefix that is of the rare class, and
* each pair of its prefix's tokens of the frequent class,

where the prefix is extended until (rare tokens) + (frequent tokens - 1) reaches t + 1: then a partner that
lacks any t tokens still shares a rare token or a pair. Documents of over COMBINED tokens would make too many
pairs, so they index frequent tokens singly; those of at least 3/4 of that do both, so that any two
documents that can link share a kind. Sharing a signature makes a candidate, which is verified on whole sets.

Steps, each over all documents:
1. Equal sets fall together; the smallest doc_id stands for them. Where an id names several rows, each set that it stands
   for gets an id of its own, below all others; components then take their sets' smallest doc_id.
2. Document frequencies: each task sends its distinct tokens, counted and packed by hash range; tokens in at
   least FREQUENT sets, at most MOST_FREQUENT of them, are broadcast (12 bytes each). Only speed hangs on
   which those are.
3. Signatures, packed by hash range, meet in lists. Rare tokens are in under FREQUENT sets; their lists give
   all pairs, with the number of tokens shared. So do short lists of the frequent class; a long one gives a
   star around its most typical document, the one of which the largest part is frequent.
4. Counts prove most pairs unable to link: with rare prefixes, at most (shared + 3/4 of the larger - 1) tokens
   are common; with prefixes that reach the frequent class, all rare tokens are indexed, and at most (shared +
   the fewer frequent tokens) are. The rest is verified on whole sets.
5. Verified pairs are links; components by star contraction.
6. Documents of long lists that still stand in different components are verified against each other where
   these counts allow a link, so none is lost to the stars.

Defined results: a null or wordless text has no tokens, links with nothing and is its own component; fewer
words than five are one token; a null doc_id is given the component of its text's other copies, null if it
has none; repeated rows stay, each with its own result; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, table, written
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingle_set

FREQUENT, MOST_FREQUENT, COMBINED, SHORT_LIST = 32, 1_000_000, 64, 32
#: Tokens that a task gathers before it packs them; tokens that a bucket should hold.
GATHERED, BUCKET_TOKENS = 1 << 21, 1 << 20
#: Ids that may be broadcast, 8 bytes each; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Documents for which a table of ids gets one file.
FILE_ROWS = 1 << 20
#: Jaccard similarity of at least 3/4.
NUM, DEN = 3, 4

_SINGLE, _COMBINED = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def least_own(n):
    """The fewest tokens of its own that a document of n shares with any partner: ceil(3n/4)."""
    return -(-NUM * n // DEN)


def least_overlap(n, m):
    """The overlap at which sets of n and m link: ceil(3 (n + m) / 7)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, high, low): the size and a 128-bit hash of each document's set."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        sums = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "n", "high", "low"])

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, n long, high long, low long")


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is or isn't among the ids; their count decides whether they are broadcast."""
    ids = ids.select(F.col("doc_id").alias("_joined_id"))
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"] == ids["_joined_id"], how)


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys' buckets (their leading bits) that aren't empty, and where those start, with the end."""
    buckets = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    return buckets[starts].astype(np.int64), np.append(starts, len(keys))


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def frequencies(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(key, df) of tokens in at least so many documents; key is the leading 32 + bits bits of a token."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text))
                size += len(held[-1])
                if size >= GATHERED:
                    yield packed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def packed(tokens: np.ndarray) -> pa.RecordBatch:
        keys, counts = np.unique(tokens, return_counts=True)
        full, at = _split(keys, bits)
        rows = []
        for k, bucket in enumerate(full):
            part = slice(at[k], at[k + 1])
            more = np.flatnonzero(counts[part] > 1).astype(np.uint32)
            rows.append((int(bucket), _low(keys[part], bits).tobytes(), more.tobytes(), counts[part][more].astype(np.uint32).tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["bucket", "low", "more", "counts"])

    def total(group: pa.Table) -> pa.Table:
        lows, weights = [], []
        for low, more, counts in zip(*(group.column(c).to_pylist() for c in ("low", "more", "counts")), strict=True):
            lows.append(np.frombuffer(low, np.uint32))
            w = np.ones(len(lows[-1]), np.int64)
            w[np.frombuffer(more, np.uint32)] = np.frombuffer(counts, np.uint32)
            weights.append(w)
        low, w = np.concatenate(lows), np.concatenate(weights)
        order = np.argsort(low, kind="stable")
        low, w = low[order], w[order]
        starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        df = np.add.reduceat(w, starts)
        often = df >= least
        return pa.table({"key": pa.array((group.column("bucket")[0].as_py() << 32) + low[starts][often].astype(np.int64)), "df": pa.array(df[often])})

    blocks = docs.select("text").mapInArrow(gather, "bucket int, low binary, more binary, counts binary")
    return blocks.groupBy("bucket").applyInArrow(total, "key long, df long")


def frequent_tokens(docs: DataFrame, bits: int, files: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and the rank by frequency of the frequent class. Where over MOST_FREQUENT tokens are in
    FREQUENT sets, the least number of sets is doubled until no more remain: that bounds the broadcast."""
    found = written(frequencies(docs, bits, FREQUENT), "frequent", files)
    least = FREQUENT
    by_size = sorted((r["power"], r["n"]) for r in found.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count("*").alias("n")).collect())
    while sum(n for power, n in by_size if 2**power >= least) > MOST_FREQUENT:
        least *= 2
    rows = found.where(F.col("df") >= least).toPandas()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    return rows["key"].to_numpy(np.uint64)[order], np.minimum(np.log2(rows["df"].to_numpy(float)[order] + 1) * 8, 255).astype(np.uint8)


def signatures(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of the rare class, of the frequent class, and the number of frequent tokens if the prefix
    reaches that class, else 0."""
    n = len(tokens)
    if n < NUM:  # links with its equal only
        return tokens[:0], tokens[:0], 0
    need = n - least_own(n) + 1
    if len(frequent):
        keys = tokens >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        often = frequent[at] == keys
    else:
        often = np.zeros(n, bool)
    rare = tokens[~often][:need]
    if len(rare) == need:
        return rare, tokens[:0], 0
    hot, level = tokens[often], rank[at[often]]
    hot = hot[np.lexsort((hot, level))]
    missing = need - len(rare)
    out = []
    if n >= COMBINED * NUM // DEN:
        out.append(mix(hot[:missing] ^ _SINGLE))
    if n <= COMBINED:
        prefix = hot[: missing + 1]
        a, b = np.triu_indices(len(prefix), 1)
        out.append(mix(mix(prefix[a] ^ _COMBINED) + prefix[b]))
    return rare, np.concatenate(out), len(hot)


#: Columns of packed postings: signature's bits after the bucket's, document, its tokens, its frequent tokens
#: where its prefix reaches them, and the signature's class.
POSTING = {"low": np.uint32, "doc": np.int64, "n": np.uint32, "hot": np.uint32, "kind": np.uint8}


def posting_blocks(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, bits: int) -> DataFrame:
    """Postings packed by bucket."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_rank = sent.value
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text)
                rare, hot, count = signatures(tokens, own, own_rank, bits)
                for sigs, kind in ((rare, 0), (hot, 1)):
                    if len(sigs):
                        held.append((sigs, doc, len(tokens), count, kind))
                        size += len(sigs)
                if size >= GATHERED // 2:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(h[0]) for h in held]
        sigs = np.concatenate([h[0] for h in held])
        order = np.argsort(sigs, kind="stable")
        sigs = sigs[order]
        rest = [np.repeat(np.array([h[k] for h in held], t), sizes)[order] for k, t in enumerate(list(POSTING.values())[1:], 1)]
        full, at = _split(sigs, bits)
        cut = [[v[at[k] : at[k + 1]].tobytes() for k in range(len(full))] for v in (_low(sigs, bits), *rest)]
        return pa.record_batch([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cut)], ["bucket", *POSTING])

    return docs.select("doc_id", "text").mapInArrow(gather, "bucket int, " + ", ".join(f"{c} binary" for c in POSTING))


def _linkable(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


#: What meets: kind 0 is a pair of documents x and y with their shared rare tokens, sizes and frequent tokens;
#: kind 2 says that document y is in a long list whose star is around x. Lists around one document count as one.
MET = "x long, y long, kind long, shared long, n long, m long, hot_x long, hot_y long"


def meet(group: pa.Table) -> pa.Table:
    """The pairs and the members of long lists of a bucket."""
    low, doc, n, hot, kind = (np.concatenate([np.frombuffer(b, t) for b in group.column(c).to_pylist()]) for c, t in POSTING.items())
    order = np.lexsort((doc, low))
    low, doc, n, hot, kind = low[order], doc[order], n[order].astype(np.int64), hot[order].astype(np.int64), kind[order]
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    lengths = np.diff(np.append(starts, len(low)))
    long = (kind[starts] == 1) & (lengths > SHORT_LIST)
    parts = []

    def pairs(a: np.ndarray, b: np.ndarray) -> None:
        shared = 1 - (kind[a] | kind[b]).astype(np.int64)
        keep = (doc[a] != doc[b]) & _linkable(n[a], n[b]) & ((shared == 1) | (np.minimum(hot[a], hot[b]) >= least_overlap(n[a], n[b])))
        a, b, shared = a[keep], b[keep], shared[keep]
        parts.append(np.stack([doc[a], doc[b], np.zeros(len(a), np.int64), shared, n[a], n[b], hot[a], hot[b]]))

    for size in np.unique(lengths[~long]):
        if size > 1:
            rows = starts[~long & (lengths == size)]
            i, j = np.triu_indices(size, 1)
            pairs((rows[:, None] + i).ravel(), (rows[:, None] + j).ravel())
    seen = set()
    for start, size in zip(starts[long], lengths[long], strict=True):
        span = np.arange(start, start + size)
        # a document links by frequent tokens only with one that isn't too long for the tokens it has
        least = np.partition(n[span], 1)[:2]
        other = np.where(n[span] == least[0], least[1], least[0])
        span = span[hot[span] >= least_overlap(n[span], np.maximum(other, least_own(n[span])))]
        same = xxhash.xxh3_64_intdigest(doc[span].tobytes())
        if len(span) < 2 or same in seen:
            continue
        seen.add(same)
        middle = span[np.argmax(hot[span] / n[span])]
        others = span[span != middle]
        pairs(np.minimum(others, middle), np.maximum(others, middle))
        none = np.zeros(len(span), np.int64)
        parts.append(np.stack([none + doc[middle], doc[span], none + 2, none, n[span], none, hot[span], none]))
    rows = np.concatenate(parts, axis=1) if parts else np.empty((8, 0), np.int64)
    rows = rows[:, np.lexsort((rows[1], rows[0], rows[2]))]
    fresh = np.flatnonzero(np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))[: rows.shape[1]]
    if len(fresh):
        shared = np.add.reduceat(rows[3], fresh)
        rows = rows[:, fresh]
        rows[3] = shared
    return pa.table({c.split()[0]: rows[k] for k, c in enumerate(MET.split(", "))})


def verified(docs: DataFrame, pairs: DataFrame, files: int) -> DataFrame:
    """The pairs (x, y) of documents whose sets link. Only the sets that are needed are built; each pair meets
    its two sets by shuffled joins, which split a hot document."""
    pairs = written(pairs, "pairs", files)
    ids = written(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), "ids", files)

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "tokens"])

    sets = written(arrow_map(join_ids(docs.select("doc_id", "text"), ids, "left_semi"), build, "doc_id long, tokens binary"), "sets", 8 * files)

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([s, t])
            both.sort()
            overlap = int(np.count_nonzero(both[1:] == both[:-1]))
            hit.append(overlap >= least_overlap(len(s), len(t)))
        return pa.record_batch([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(hit, pa.bool_()))

    first, second = (sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "xy")
    joined = pairs.join(first, "x").join(second, "y").select("x", "y", "tokens_x", "tokens_y")
    return arrow_map(joined, check, "x long, y long")


def links(docs: DataFrame, total: int, files: int) -> DataFrame:
    """Links (x, y) that connect all documents whose sets link; docs holds each set once. Not every link is
    listed: those between documents that other links connect may be absent."""
    bits = max(6, (total // BUCKET_TOKENS).bit_length())  # of a 31-bit column: enough for 10^15 tokens
    frequent, rank = frequent_tokens(docs, bits, files)
    blocks = posting_blocks(docs, frequent, rank, bits)
    met = written(blocks.groupBy("bucket").applyInArrow(meet, MET), "met", 2 * files)
    same = [F.first(c).alias(c) for c in ("n", "m", "hot_x", "hot_y")]
    pairs = met.where("kind = 0").groupBy("x", "y").agg(F.sum("shared").alias("shared"), *same)
    overlap = F.ceil(F.expr(f"{NUM} * (n + m)") / F.lit(NUM + DEN))
    own = F.ceil(F.expr(f"{NUM} * greatest(n, m)") / F.lit(DEN))
    most = F.col("shared") + F.when((F.col("hot_x") > 0) & (F.col("hot_y") > 0), F.least("hot_x", "hot_y")).otherwise(own - 1)
    found = written(verified(docs, pairs.where(most >= overlap).select("x", "y"), files), "links", files)
    members = met.where("kind = 2").select(F.col("x").alias("list"), F.col("y").alias("node"), "n", F.col("hot_x").alias("hot")).distinct()
    if not members.take(1):
        return found
    named = members.join(components(found, files), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "members", files)
    open_lists = named.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("list")
    apart = named.join(open_lists, "list", "left_semi").groupBy("list").applyInArrow(across, "x long, y long").distinct()
    return found.unionByName(written(verified(docs, apart, files), "links", files))


def across(group: pa.Table) -> pa.Table:
    """Pairs of a list's documents that stand in different components and may link by frequent tokens."""
    node, n, hot, part = (group.column(c).to_numpy() for c in ("node", "n", "hot", "component"))
    names, at, sizes = np.unique(part, return_inverse=True, return_counts=True)
    main = sizes.argmax()
    xs, ys = [], []
    for i in np.flatnonzero(at != main):  # all but the largest component's, against those not seen yet
        others = (part != part[i]) & ((at == main) | (node > node[i])) & _linkable(n, n[i]) & (np.minimum(hot, hot[i]) >= least_overlap(n, n[i]))
        xs.append(np.full(int(others.sum()), node[i]))
        ys.append(node[others])
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
    return pa.table({"x": np.minimum(x, y).astype(np.int64), "y": np.maximum(x, y).astype(np.int64)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_id, high, low) of every row. Equal component ids are of one component, but
    where an id names several texts; group_id tells those apart. high and low are the hash of the row's set."""
    files = 1 + docs.count() // FILE_ROWS
    sets = written(set_rows(docs), "set-rows", files)
    first = sets.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("own"))
    rows = written(sets.join(first, ["high", "low"], "left").select("doc_id", "n", "high", "low", "own"), "rows", files)
    named_rows = rows.where("doc_id is not null")
    several = written(named_rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("n") > 0).alias("any")).where("any and rows > 1").select("doc_id"), "repeated", files)
    copies = named_rows.where("n = 0 or own <> doc_id").select("doc_id").unionByName(several.select("doc_id"))
    copies = written(copies.distinct(), "copies", files)
    total = rows.agg(F.sum("n")).first()[0] or 0
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    single = join_ids(texts, copies, "left_anti")
    if not several.take(1):
        return _with_components(rows, components(links(single, total, files), files), files)
    # ids of several rows: each set that such an id stands for is taken up once, under an id of its own
    ids = rows.where("own is not null").join(several, rows["own"] == several["doc_id"], "left_semi").select("high", "low", "own").distinct()
    lowest = (named_rows.agg(F.min("doc_id")).first()[0] or 0) - 1
    ids = written(written(ids, "own-sets", files).withColumn("node", F.lit(lowest) - F.monotonically_increasing_id()), "nodes")
    held = with_hashes(join_ids(texts, several, "left_semi"))
    more = held.join(ids, ["high", "low"]).where("doc_id = own").groupBy("node").agg(F.first("text").alias("text"))
    all_single = single.unionByName(written(more.select(F.col("node").alias("doc_id"), "text"), "own-texts", files))
    found = components(links(all_single, total, files), files)
    real = found.join(ids.select("node", "own"), "node", "left").withColumn("id", F.coalesce("own", "node"))
    least = real.groupBy("component").agg(F.min("id").alias("least"))
    named = written(found.join(least, "component"), "named", files)
    of_set = ids.join(named, "node", "left").select("high", "low", F.coalesce("least", "own").alias("component_id"), F.coalesce("component", "node").alias("group_id"))
    usual = _with_components(rows.join(ids.select("high", "low"), ["high", "low"], "left_anti"), named, files)
    own = rows.join(of_set, ["high", "low"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group_id", "high", "low")
    return usual.unionByName(own)


def with_hashes(docs: DataFrame) -> DataFrame:
    """docs with high and low, the hash of a text's set, as the last columns."""
    names = docs.columns
    at = names.index("text")
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in batch.column(at).to_pylist()]
        both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
        return pa.record_batch([*batch.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], [*(f"c{k}" for k in range(len(names))), "high", "low"])

    schema = ", ".join(f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", high long, low long"
    return arrow_map(numbered, kernel, schema).toDF(*names, "high", "low")


def _with_components(rows: DataFrame, found: DataFrame, files: int) -> DataFrame:
    """Rows, whose sets are named by the smallest doc_id, with their components; found may have the smallest doc_id of a
    component as least."""
    least = "least" if "least" in found.columns else "component"
    named = written(found.select(F.col("node").alias("own"), F.col("component").alias("group_id"), F.col(least).alias("component_id")), "components", files)
    single = F.coalesce("own", F.when(F.col("n") == 0, F.col("doc_id")))
    return rows.join(named, "own", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", single).alias("component_id"), F.coalesce("group_id", single).alias("group_id"), "high", "low")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
    from documents
), s as (
    select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as tokens
    from w
), u as (
    select doc_id, len(tokens) as n, unnest(tokens) as t from s
), e as (
    select a.doc_id as x, b.doc_id as y from u a join u b on a.t = b.t and a.doc_id <> b.doc_id
    group by 1, 2 having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r as (
    select distinct x as doc_id, x as c from e
    union
    select e.y, r.c from r join e on e.x = r.doc_id
), least_of as (
    select doc_id, min(c) as c from r group by doc_id
)
select s.doc_id, cast(len(tokens) as bigint) as n_shingles, coalesce(c, s.doc_id) as component_id
from s left join least_of on least_of.doc_id = s.doc_id
"""
