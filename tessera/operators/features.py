"""Features of candidate pairs, their context within query and index record, and TF-IDF cosines.

Missing is null. What hangs on one record alone (frequencies of its name, TF-IDF vectors) is an attribute of the
record, made once and gathered with its other columns. One Arrow kernel then makes all string scores and cosines of a
pair; texts and vectors that pairs share are prepared once.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as T
from tessera.operators import tokens
from tessera.operators.dense import cosine
from tessera.session import written

#: The names and order of a pair's features are fixed values, a contract between models and their users.
BASE = (
    "n_ratio", "n_pratio", "n_tsort", "n_tset", "n_jw", "n_lev_full", "n_tset_full", "n_concat_ratio", "n_concat_pratio", "n_skel_ratio", "n_alias_best", "n_cos_char", "n_cos_word", "n_jacc", "n_first_eq", "n_len_q", "n_len_i", "n_ntok_diff", "i_translit", "i_domain", "i_alias",
    "a_empty_i", "a_ratio", "a_tsort", "a_tset", "a_pratio", "a_core_tset", "a_alpha_tset", "a_skel_ratio", "a_cos_word", "a_num_jacc", "a_first_num_eq", "a_qnum_in_i", "a_num_conflict", "a_state_eq", "a_len_i", "a_ncomp_i", "i_addr_translit",
    "src_s3", "bscore", "brank", "b_ntypes", "bit_nt", "bit_ns", "bit_ph", "bit_an", "bit_nh", "bit_np", "bit_nc", "bit_bm25", "bit_dense", "dense_cos", "emb_cos", "n_phon_ratio",
    "q_name_df_s1", "i_name_df_idx", "i_name_df_s1",
)
CONTEXT = (
    "g_max_n_tset", "g_diff_n_tset", "g_rank_n_tset", "g_max_a_tset", "g_diff_a_tset", "g_rank_a_tset", "g_max_combo", "g_diff_combo", "g_rank_combo", "g_rank_bscore", "q_ncand",
    "i_ncand_s1", "i_rank_combo", "i_diff_combo", "i_rank_bscore",
)
CORE = ("n_tset", "a_tset", "n_cos_char", "a_cos_word", "a_num_jacc", "a_first_num_eq", "a_empty_i", "bscore", "i_name_df_s1", "q_name_df_s1", "n_alias_best", "a_state_eq", "emb_cos", "i_domain", "i_translit")
SECOND = (
    "p1_logit", "g_rank_p1", "g_max_p1", "g_diff_p1", "g_second_p1", "g_sum_p1", "g_cnt50_p1", "q_ncand", "i_ncand_s1", "i_rank_p1", "i_max_other_p1", "i_diff_other_p1",
    "c2t_n1", "c2t_a1", "c2t_n2", "c2t_a2", "support_n", "support_a",
)
#: Characters of a text that string scorers see in the linkage of business records, as in the published one; None: all.
SCORED_CHARS = 200
#: Parts that are mostly equal to another one of the record; null is equal. n_concat and n_phon can be left out.
EQUALS = {"n_full": "n_core", "n_alt_a": "n_core", "n_alt_b": "n_core", "a_core": "a_full"}
#: Vectors of a record: name and its terms.
VECTORS = ("n_cos_char", "n_cos_word", "a_cos_word")
#: Terms of vectors that a worker remembers; when full, it starts anew.
TERMS_KEPT = 400_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def tfidf(records: DataFrame, doc: str, terms: str, part: tuple[str, ...] = ()) -> DataFrame:
    """(part, doc, term, w): sublinear term frequency times ln((1 + n) / (1 + df)) + 1, normalised by document; n and
    df are those of a partition."""
    part = list(part)
    rows = written(records.select(*part, doc, F.explode(terms).alias("term")).groupBy(*part, doc, "term").agg(F.count("*").alias("tf")), "terms")
    df = rows.groupBy(*part, "term").agg(F.count("*").alias("df"))
    n = records.groupBy(*part).agg(F.count("*").alias("n"))
    joined = rows.join(df, [*part, "term"])
    joined = joined.join(n, part) if part else joined.join(F.broadcast(n))
    weighted = joined.withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = Window.partitionBy(*part, doc)
    return weighted.select(*part, doc, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("w"))


def pair_cosine(pairs: DataFrame, query: DataFrame, index: DataFrame) -> DataFrame:
    """(q_id, i_id, cos) of pairs; weights (q_id or i_id, term, w); 0 without common terms."""
    scored = pairs.join(query.withColumnRenamed("w", "wq"), "q_id").join(index.withColumnRenamed("w", "wi"), ["i_id", "term"])
    return pairs.join(scored.groupBy("q_id", "i_id").agg(F.sum(F.col("wq") * F.col("wi")).alias("cos")), ["q_id", "i_id"], "left").na.fill(0.0, ["cos"])


def _of_kind(kind: str) -> Column:
    return F.filter("v", lambda x: x["term"].startswith(kind))


def name_counts(records: DataFrame, everyone: DataFrame, part: str = "ckey") -> DataFrame:
    """records with name_df_s1 and name_df_idx: how many of everyone in the partition on either side bear the record's name.
    Names may be as long as texts, so they meet by their SHA-256."""
    name = F.sha2("n_core", 256).alias("_name")
    counts = everyone.groupBy(part, name).agg(F.count_if(F.col("src") == 1).alias("name_df_s1"), F.count_if(F.col("src") != 1).alias("name_df_idx"))
    return records.select("*", name).join(counts, [part, "_name"]).drop("_name")


def attributes(records: DataFrame, part: str = "ckey") -> DataFrame:
    """(part, id, name_df_s1, name_df_idx, <vector>_t, <vector>_w): how many records of the partition on either side bear
    the record's name, and its TF-IDF vectors as terms and weights of any length: 2- and 3-grams of padded words of n_core, words of
    n_core, words of a_full. records: (part, id, src, n_core, a_full), each once in a partition; src 1 asks."""
    counts = records.groupBy(part, "n_core").agg(F.count_if(F.col("src") == 1).alias("name_df_s1"), F.count_if(F.col("src") != 1).alias("name_df_idx"))
    named = records.join(counts, [part, "n_core"]).select(part, "id", "name_df_s1", "name_df_idx")
    padded = F.transform(words(F.col("n_core")), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda n: F.flatten(F.transform(padded, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    kinds = zip("cwa", (F.concat(grams(2), grams(3)), words(F.col("n_core")), words(F.col("a_full"))), strict=True)
    # a term's kind is its first letter, so that one pass serves all
    terms = F.concat(*(tokens.prefixed(t, k) for k, t in kinds))
    w = tfidf(records.select(part, "id", terms.alias("terms")), "id", "terms", (part,))
    held = w.groupBy(part, "id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    cols = []
    for k, name in zip("cwa", VECTORS, strict=True):
        own = _of_kind(k)
        cols += [F.transform(own, lambda x: x["term"]).alias(f"{name}_t"), F.transform(own, lambda x: x["w"]).alias(f"{name}_w")]
    return named.join(held.select(part, "id", *cols), [part, "id"], "left")


@functools.lru_cache(1 << 15)
def _grams(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[k : k + n] for n in (2, 3) for k in range(len(padded) - n + 1))


def _terms(vector: str, text: str | None) -> list[str]:
    """The terms of attributes(), outside of Spark."""
    own = [w for w in (text or "").split(" ") if w]
    return [g for w in own for g in _grams(w)] if vector == "n_cos_char" else own


def _text_of(vector: str) -> str:
    return "a_full" if vector[0] == "a" else "n_core"


def vector_words(vectors: tuple[str, ...] = VECTORS) -> tokens.Words:
    """The vectors' terms, a family each, of records with n_core and a_full."""
    columns = tuple(dict.fromkeys(map(_text_of, vectors)))

    def sets(*texts: str | None) -> tuple[set[str], ...]:
        by = {c: {w for w in (t or "").split(" ") if w} for c, t in zip(columns, texts, strict=True)}
        return tuple(set().union(*map(_grams, by[_text_of(v)])) if v == "n_cos_char" else by[_text_of(v)] for v in vectors)

    return tokens.Words(columns, vectors, sets)


def rare_terms(records: DataFrame, everyone: DataFrame, vectors: tuple[str, ...] = VECTORS, part: str = "ckey") -> tuple[DataFrame, dict]:
    """(part, id, t): the terms of records that the frequent ones, the second value, leave out, with their frequencies."""
    words = vector_words(vectors)
    df = written(tokens.frequencies(everyone, part, words), "frequencies")
    known = tokens.frequent(df)
    rare = tokens.contenders(records.select(part, "id", *words.columns), [part, "id"], words, dict.fromkeys(vectors, 0), known)
    return written(rare.join(df, [part, "family", "tok"]).groupBy(part, "id").agg(F.collect_list(F.struct("family", "tok", "df")).alias("t")), "terms"), known


def with_cosines(pairs: DataFrame, records: DataFrame, everyone: DataFrame, vectors: tuple[str, ...] = VECTORS, part: str = "ckey") -> DataFrame:
    """pairs with the cosines of long texts. everyone: (part, id, n_core, a_full) of all records, which frequencies count;
    records: those of them that pairs name; pairs: (part, q_id, i_id, q_n_core, i_n_core and so on). A record's
    vectors are made of its text where the pair is, so that no row is made for a term whose frequency many records share."""
    held, known = rare_terms(records, everyone, vectors, part)
    side = lambda s: held.select(part, F.col("id").alias(f"{s}_id"), F.col("t").alias(f"{s}_t"))
    return cosines(pairs.join(side("q"), [part, "q_id"], "left").join(side("i"), [part, "i_id"], "left"), known, everyone, vectors, part)


def cosines(pairs: DataFrame, known: dict, everyone: DataFrame, vectors: tuple[str, ...] = VECTORS, part: str = "ckey") -> DataFrame:
    """with_cosines of pairs that have their records' rare_terms as q_t and i_t, which are dropped."""
    words, spark = vector_words(vectors), pairs.sparkSession
    n = everyone.groupBy(part).agg(F.count("*").alias("_n"))
    named = pairs.join(F.broadcast(n), part)
    pairs = pairs.drop("q_t", "i_t")
    columns, at, sent = pairs.columns, {c: k for k, c in enumerate(pairs.columns)}, spark.sparkContext.broadcast(known)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[dict[str, float], ...]] = {}
        terms = 0

        def weights(vector: str, text: str | None, p, n: int, rest: dict[tuple, int]) -> dict[str, float]:
            own, once = sent.value.get((p, vector), {}), Counter(_terms(vector, text))
            w = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + (own.get(t) or rest.get((vector, t), 1)))) + 1) for t, k in once.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / norm for t, x in w.items()}

        for batch in batches:
            parts, ns, texts = batch.column(at[part]).to_pylist(), batch.column(len(columns) + 2), {c: batch.column(at[c]) for s in "qi" for c in (f"{s}_id", *(f"{s}_{t}" for t in words.columns))}
            dots: list[list[float]] = [[] for _ in vectors]
            for k, p in enumerate(parts):
                two = []
                for j, s in enumerate("qi"):
                    key = (s, p, texts[f"{s}_id"][k].as_py())
                    if (own := kept.get(key)) is None:
                        if terms > TERMS_KEPT:
                            kept.clear()
                            terms = 0
                        rest = {(x["family"], x["tok"]): x["df"] for x in batch.column(len(columns) + j)[k].as_py() or ()}
                        own = kept[key] = tuple(weights(v, texts[f"{s}_{_text_of(v)}"][k].as_py(), p, ns[k].as_py(), rest) for v in vectors)
                        terms += sum(map(len, own))
                    two.append(own)
                for to, x, y in zip(dots, *two, strict=True):
                    short, long = (x, y) if len(x) <= len(y) else (y, x)
                    to.append(sum(w * long[t] for t, w in short.items() if t in long))
            yield pa.record_batch([*batch.columns[: len(columns)], *(pa.array(d, pa.float64()) for d in dots)], [*columns, *vectors])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"{v} double" for v in vectors])
    return named.select(*columns, "q_t", "i_t", "_n").mapInArrow(kernel, schema)


def lean(records: DataFrame) -> DataFrame:
    """records without what string_features makes of their other parts: pairs bring both records' texts through shuffles."""
    return records.drop("n_concat", "n_phon").withColumns({c: F.when(F.col(c) != F.col(of), F.col(c)) for c, of in EQUALS.items() if c in records.columns})


def string_features(pairs: DataFrame, gate: Column, scores: tuple[str, ...] = tuple(sim.SCORES), chars: int | None = SCORED_CHARS) -> DataFrame:
    """pairs with the scores, all or those named, of the name and address columns q_<part> and i_<part>, null where the
    gate is shut or a side is empty, and the cosines of the vectors q_<vector>_t, q_<vector>_w and so on, which every pair
    has, unless the pairs bring their cosines. Records may be lean. chars: of a text that are scored, None for whole texts."""
    columns = pairs.columns
    vectors_of = [v for v in VECTORS if f"q_{v}_t" in columns]
    out = [*scores, *vectors_of]
    at = {c: k for k, c in enumerate(columns)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, vectors = sim.Scorer(), {}

        def vector(side: str, name: str, batch: pa.RecordBatch) -> list[dict[str, float]]:
            ids, rows = batch.column(at[f"{side}_id"]).to_pylist(), []
            terms, weights = batch.column(at[f"{side}_{name}_t"]), batch.column(at[f"{side}_{name}_w"])
            own = vectors.setdefault((side, name), {})
            if len(own) > sim.TEXTS_KEPT:
                own.clear()
            parts = batch.column(at["ckey"]).to_pylist() if "ckey" in at else [None] * len(ids)
            for k, key in enumerate(zip(parts, ids, strict=True)):
                if key not in own:
                    w = weights[k].as_py() or ()
                    norm = math.sqrt(sum(x * x for x in w))
                    own[key] = {t: x / norm for t, x in zip(terms[k].as_py() or (), w, strict=True)}
                rows.append(own[key])
            return rows

        def whole(side: str, part: str, batch: pa.RecordBatch) -> list[str]:
            if f"{side}_{part}" not in at:
                make = {"n_concat": lambda t: t.replace(" ", ""), "n_phon": T.nysiis_codes}[part]
                return [make(t) for t in whole(side, "n_core", batch)]
            own = batch.column(at[f"{side}_{part}"]).to_pylist()
            if part in EQUALS and None in own:
                own = [of if t is None else t for t, of in zip(own, whole(side, EQUALS[part], batch), strict=True)]
            return [t or "" for t in own]

        for batch in batches:
            shown, cut = batch.column(len(columns)).to_pylist(), {}
            scorer.forget()

            def texts(side: str, part: str, batch=batch, cut=cut) -> list[str]:
                if (side, part) not in cut:
                    cut[side, part] = [t[:chars] for t in whole(side, part, batch)]
                return cut[side, part]

            new = []
            for name in scores:
                _, a, b = sim.SCORES[name]
                q, i = texts("q", a), texts("i", b)
                sides = (texts("q", "n_core"), i if name.startswith("n_alias") else texts("i", "n_core")) if name[0] == "n" else (texts("q", "a_full"), texts("i", "a_full"))
                new.append(pa.array(scorer.column(name, q, i, [bool(s and x and y) for s, x, y in zip(shown, *sides, strict=True)]), pa.float64()))
            for name in vectors_of:
                dots = [sum(w * long[t] for t, w in short.items() if t in long) for x, y in zip(vector("q", name, batch), vector("i", name, batch), strict=True) for short, long in [(x, y) if len(x) <= len(y) else (y, x)]]
                new.append(pa.array(dots, pa.float64()))
            yield pa.record_batch([*batch.columns[: len(columns)], *new], [*columns, *out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"{c} double" for c in out])
    scored = pairs.withColumn("_gate", F.coalesce(gate, F.lit(False))).mapInArrow(kernel, schema)
    addresses = (F.col("q_a_full") != "") & (F.col("i_a_full") != "")
    more = {}
    if set(sim.SCORES) == set(scores):
        more["n_alias_best"] = F.greatest("n_alias_a", "n_alias_b")
    if "a_cos_word" in scored.columns:
        more["a_cos_word"] = F.when(addresses, F.col("a_cos_word"))
    return scored.withColumns(more).drop("n_alias_a", "n_alias_b", "_gate", *(f"{s}_{v}_{x}" for s in "qi" for v in VECTORS for x in "tw"))


def set_features(pairs: DataFrame) -> DataFrame:
    """Lengths, numbers, flags and retrieval bits of a pair, native."""
    q, i = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"i_{c}"))
    nq, ni = words(q("a_nums")), words(i("a_nums"))
    both = (F.size(nq) > 0) & (F.size(ni) > 0)
    first = lambda c: F.get(words(c), F.lit(0))
    return pairs.withColumns({
        "n_jacc": sim.jaccard(words(q("n_core")), words(i("n_core"))),
        "n_first_eq": F.coalesce(first(q("n_core")), F.lit("")).eqNullSafe(F.coalesce(first(i("n_core")), F.lit(""))).cast("int"),
        "n_len_q": F.length(q("n_core")), "n_len_i": F.length(i("n_core")),
        "n_ntok_diff": F.abs(F.size(words(q("n_core"))) - F.size(words(i("n_core")))),
        "i_translit": i("n_translit").cast("int"), "i_domain": i("n_domain").cast("int"), "i_alias": i("n_alias").cast("int"),
        "a_empty_i": (i("a_full") == "").cast("int"),
        "a_num_jacc": F.when(both, sim.jaccard(nq, ni)), "a_num_conflict": F.when(both, (~F.arrays_overlap(nq, ni)).cast("int")),
        "a_first_num_eq": F.when((q("a_first_num") != "") & (i("a_first_num") != ""), (q("a_first_num") == i("a_first_num")).cast("int")),
        "a_qnum_in_i": F.when(q("a_first_num") != "", F.array_contains(ni, q("a_first_num")).cast("int")),
        "a_len_i": F.length(i("a_full")), "a_ncomp_i": i("a_ncomp"), "src_s3": (F.col("src") == 3).cast("int"),
        "b_ntypes": F.bit_count("bits"),
        **{f"bit_{n}": F.getbit("bits", F.lit(b)).cast("int") for n, b in (("nt", 0), ("ns", 1), ("an", 2), ("nh", 3), ("np", 4), ("nc", 5), ("ph", 6), ("dense", 7), ("bm25", 8))},
    })


def dense_features(pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """emb_cos of every pair and dense_cos of pairs that the dense search found; null without vectors (id, v)."""
    if vectors is None:
        return pairs.withColumns({"emb_cos": F.lit(None).cast("double"), "dense_cos": F.lit(None).cast("double")})
    out = pairs.join(vectors.select(F.col("id").alias("q_id"), F.col("v").alias("_q")), "q_id", "left").join(vectors.select(F.col("id").alias("i_id"), F.col("v").alias("_i")), "i_id", "left")
    cos = cosine(F.col("_q"), F.col("_i"))
    return out.withColumn("emb_cos", cos).withColumn("dense_cos", F.when(F.getbit("bits", F.lit(7)) == 1, F.col("emb_cos"))).drop("_q", "_i")


def context_features(pairs: DataFrame) -> DataFrame:
    """Best, gap and rank of n_tset, a_tset and their mean within the query, of the mean within the index record."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = pairs.withColumn("combo", 0.5 * zero("n_tset") + 0.5 * zero("a_tset"))
    q, i = Window.partitionBy("q_id"), Window.partitionBy("i_id")
    new = {}
    for c in ("n_tset", "a_tset", "combo"):
        new |= {f"g_max_{c}": F.max(c).over(q), f"g_diff_{c}": zero(c) - F.coalesce(F.max(c).over(q), F.lit(0.0)), f"g_rank_{c}": F.row_number().over(q.orderBy(F.col(c).desc_nulls_last(), "i_id"))}
    new |= {"g_rank_bscore": F.row_number().over(q.orderBy(F.desc("bscore"), "i_id")), "q_ncand": F.count("*").over(q), "i_ncand_s1": F.count("*").over(i)}
    new |= {"i_rank_combo": F.row_number().over(i.orderBy(F.desc("combo"), "q_id")), "i_diff_combo": F.col("combo") - F.max("combo").over(i), "i_rank_bscore": F.row_number().over(i.orderBy(F.desc("bscore"), "q_id"))}
    return out.withColumns(new)


def cluster_support(pairs: DataFrame, texts: DataFrame, score: str = "jaccard") -> DataFrame:
    """(q_id, i_id, c1, c2, support): similarity of a candidate with the query's best and second best other candidates,
    and their mean weighted by p. pairs: (q_id, i_id, p); texts: (i_id, toks), null toks being no text. The score is the
    word Jaccard or, as token_set, token_set_ratio (1 for equal texts)."""
    w = Window.partitionBy("q_id").orderBy(F.desc("p"), "i_id")
    ranked = pairs.withColumn("rk", F.row_number().over(w))
    named = ranked.join(texts, "i_id")
    top = named.where("rk <= 3").groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rk", "p", "toks"))).alias("top"))
    others = F.filter("top", lambda t: t["rk"] != F.col("rk"))
    out = named.join(top, "q_id").withColumn("o", others)
    other = lambda k, field: F.get("o", F.lit(k))[field]
    similar = (lambda a, b: sim.jaccard(a, b)) if score == "jaccard" else (lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(sim.indel_token_set(F.array_join(a, " "), F.array_join(b, " "))))
    c = [F.when(F.size("o") > k, similar(F.col("toks"), other(k, "toks"))) for k in (0, 1)]
    wt = [F.coalesce(other(k, "p"), F.lit(0.0)) for k in (0, 1)]
    out = out.withColumns({"c1": c[0], "c2": c[1], "w1": wt[0], "w2": wt[1]})
    total = (F.coalesce("c1", F.lit(0.0)) * F.col("w1") + F.coalesce("c2", F.lit(0.0)) * F.col("w2")) / (F.col("w1") + F.col("w2") + 1e-6)
    return out.select("q_id", "i_id", F.round("c1", 6).alias("c1"), F.round("c2", 6).alias("c2"), F.round(total, 6).alias("support"))
