"""Language identification by Bayesian evidence fusion.

Evidence on a text's language: its words, by a character n-gram model of each language; the language that its
markup declares; and where it lies. The posterior is the normalised product of

* the text's likelihood: n-grams of NGRAM letters, additively smoothed, tempered as neighbouring n-grams aren't
  independent. A background with equal chances for all n-grams stands for all other languages; an n-gram that
  a language's sample lacks is at most a tenth as likely there. In a text of any language a share NOISE of words
  is of none (codes, names, addresses), so that such words weigh little against it;
* the declaration's likelihood, P(declared | language), from a grouped count of declarations;
* the host's prior. Posteriors of the first two are summed by host; these sums by domain, and those by address
  suffix. Each level is smoothed by the next wider one: (sum + STRENGTH * wider prior) / (count + STRENGTH), up to the
  whole table's. A row's own part is taken out of every level, so that it isn't counted twice.

A row meets the sums of its host and of all levels above in one join with the table of hosts. Hosts that hold over one
in HOT_SHARE of all rows, so fewer than HOT_SHARE hosts, are broadcast; rows of all others are joined by shuffle.

A text is rejected if it has no letters, if the background wins, or if the best posterior is under ACCEPT.

The n-gram model is fitted on a sample. Labels are counted over all rows, and each label gives the texts of the
smallest hashes of their id: its share of SAMPLE by count, LEAST at least (all if it has fewer). So each label named in
the table gets a model and keeps its declarations. The sampled texts' n-grams, of whole texts, are counted by the
executors; the driver gets the counts. All counts for priors and declarations cover all rows.

Defined results: a null or letterless text has the language null and is rejected; null or unknown
declarations and addresses count as none, which is a value of its own; repeated rows count each; of languages with
equal posteriors the first by name wins; an empty table gives no rows; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, table, written

SAMPLE, LEAST, NGRAM, SMOOTH, TEMPER, NOISE = 2000, 200, 3, 0.5, 0.3, 0.1
STRENGTH, ACCEPT, HOT_SHARE = 20.0, 0.5, 1000
OTHER = "other"
#: N-grams that the background holds equally likely.
BACKGROUND = 4000
_WORDS_KEPT = 200_000
#: Parts of an address, the widest first.
LEVELS = ("suffix", "domain", "host")
#: Named character references of letters of western European languages.
ENTITIES = {f"{base}{mark}": unicodedata.normalize("NFC", base + sign) for mark, sign, bases in (("acute", "\u0301", "aeiouyAEIOUY"), ("grave", "\u0300", "aeiouAEIOU"), ("circ", "\u0302", "aeiouAEIOU"), ("uml", "\u0308", "aeiouyAEIOU"), ("tilde", "\u0303", "anoANO"), ("cedil", "\u0327", "cC"), ("ring", "\u030a", "aA")) for base in bases} | {"szlig": "ß", "aelig": "æ", "oelig": "œ", "oslash": "ø", "AElig": "Æ", "Oslash": "Ø"}
_LETTERS = re.compile(r"[^\W\d_]+")


def ngrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + NGRAM] for i in range(max(1, len(padded) - NGRAM + 1))]


class Model:
    """Log-likelihoods of words in each language, the background last."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        """counts: of the n-grams of each language."""
        self.languages = sorted(k for k in counts if k)
        kinds = len({g for c in counts.values() for g in c}) + BACKGROUND
        self.scores: dict[str, list[float]] = {}
        totals = {lang: sum(counts[lang].values()) for lang in self.languages}
        self.unseen = np.array([math.log(min(SMOOTH / (totals[lang] + SMOOTH * kinds), 0.1 / BACKGROUND)) for lang in self.languages] + [-math.log(BACKGROUND)])
        for g in {g for lang in self.languages for g in counts[lang]}:
            self.scores[g] = [math.log((counts[lang][g] + SMOOTH) / (totals[lang] + SMOOTH * kinds)) for lang in self.languages] + [-math.log(BACKGROUND)]

    def likelihood(self, word: str) -> np.ndarray:
        """Of a word in each language; in any text a share NOISE of words is of no language."""
        own = np.sum([self.scores[g] if g in self.scores else self.unseen for g in ngrams(word)], axis=0)
        return np.logaddexp(own + math.log(1 - NOISE), own[-1] + math.log(NOISE))


def gram_counts(samples: Iterable[tuple[str, str | None]]) -> dict[str, Counter]:
    """Counts of n-grams of (language, text). Each distinct word of a text counts once, so no long text prevails."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in samples:
        own = counts[lang]
        for word in set(_LETTERS.findall((text or "").lower())):
            own.update(ngrams(word))
    return counts


class _Rows(dict):
    """Word -> row of its log-likelihoods in a matrix that grows as words appear."""

    def __init__(self, model: Model) -> None:
        self.model, self.matrix = model, np.empty((1024, len(model.unseen)))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[row] = self.model.likelihood(word)
        return row


class Scorer:
    def __init__(self, model: Model) -> None:
        self.rows = _Rows(model)

    def score(self, text: str | None) -> list[float] | None:
        """Tempered log-likelihoods, the best 0; null without letters."""
        words = _LETTERS.findall((text or "").lower())
        if not words:
            return None
        if len(self.rows) > _WORDS_KEPT:
            self.rows = _Rows(self.rows.model)
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        total = TEMPER * self.rows.matrix[rows].sum(axis=0)
        return (total - total.max()).tolist()


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer for each model that a worker has."""
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]


def train(rows: DataFrame, key: str, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Fitted on texts of every label. One pass takes the rows under a hash that twice as many as wanted should have;
    a label that still lacks rows, as many share an id, is read again by itself."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    named = rows.where(F.col(label) != "").select(F.col(label).alias("l"), place.alias("h"), F.col(key).alias("k"), F.col(text).alias("t"))
    counts = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    every = sum(counts.values())
    sizes = {lang: min(n, max(min(sample, LEAST), sample * n // every)) for lang, n in counts.items()}
    bounds = [(lang, sizes[lang], min(1 << 30, (2 * sizes[lang] << 30) // n)) for lang, n in counts.items()]
    near = named.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "l string, size long, below long")), "l").where("h < below")
    order = ["h", "k", F.xxhash64("t"), "t"]
    ranked = near.withColumn("rk", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("rk") <= max(sizes.values())).where("rk <= size")
    taken = written(ranked.select("l", "t"), "language-sample")
    found = {r["l"]: r["n"] for r in taken.groupBy("l").agg(F.count("*").alias("n")).collect()}
    short = sorted(k for k in sizes if found.get(k, 0) < sizes[k])
    parts = [taken.where(~F.col("l").isin(*short))] + [named.where(F.col("l") == lang).orderBy(*order).limit(sizes[lang]).select("l", "t") for lang in short]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        own = gram_counts(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        cells = [(lang, g, n) for lang, c in own.items() for g, n in c.items()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["l", "gram", "n"]) if cells else None

    grams: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for part in parts:
        for r in arrow_map(part, count, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).collect():
            grams[r["l"]][r["gram"]] = r["n"]
    return Model(grams)


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows, columns (key, text, declared, host, domain, suffix), with the text replaced by its log-likelihoods."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = ["key", "declared", "host", "domain", "suffix", "likelihood"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _scorer(sent.value)
        scores = pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        return pa.record_batch([batch.column(0), *(batch.column(k) for k in range(2, 6)), scores], names)

    return arrow_map(rows.select("key", "text", *names[1:5]), kernel, "key string, declared string, host string, domain string, suffix string, likelihood array<double>")


def _with_posterior(rows: DataFrame, scores: list[str], names: list[str]) -> DataFrame:
    """Each score's exponential over the sum of all, as 1 / sum(exp(other - own)); null where the scores are."""
    share = lambda own: 1 / sum((F.exp(F.col(s) - F.col(own)) for s in scores if s != own), F.lit(1.0))
    return rows.withColumns({n: F.when(F.col(s).isNotNull(), share(s)) for s, n in zip(scores, names, strict=True)})


def identified(rows: DataFrame, model: Model) -> DataFrame:
    """(key, language, posterior, accepted) of rows with columns (key, text, declared, host, domain, suffix)."""
    langs = [*model.languages, OTHER]
    count = range(len(langs))
    s, p, m = [f"s{k}" for k in count], [f"p{k}" for k in count], [f"m{k}" for k in count]
    known = F.lower(F.substring("declared", 1, 2))
    clean = rows.withColumn("declared", F.when(F.col("declared").isin(*model.languages), F.col("declared")).when(known.isin(*model.languages), known).otherwise(F.lit("")))
    clean = clean.withColumns({c: F.coalesce(c, F.lit("")) for c in LEVELS})
    scored = evidence(clean, model).select("key", "declared", *LEVELS, *(F.col("likelihood")[k].alias(s[k]) for k in count))
    scored = written(scored, "language-evidence")
    mass = [F.coalesce(F.sum(c), F.lit(0.0)).alias(m[k]) for k, c in enumerate(p)]
    # P(declared | language) from posterior mass, smoothed towards all declarations; one cell for each known language
    cells = _with_posterior(scored, s, p).groupBy("declared").agg(*mass, F.count("*").alias("n")).collect()
    every = max(1, sum(r["n"] for r in cells))
    sums = [sum(r[m[k]] for r in cells) for k in count]
    told = [F.lit(0.0) for _ in count]
    for r in cells:
        told = [F.when(F.col("declared") == r["declared"], F.lit(math.log((r[m[k]] + r["n"] / every) / (sums[k] + 1)))).otherwise(told[k]) for k in count]
    first = _with_posterior(scored.withColumns({s[k]: F.col(s[k]) + told[k] for k in count}), s, p).select("key", *LEVELS, *s, *p)
    # sums of hosts, of these by domain, of those by suffix; each host then has the sums of all its levels
    hosts = written(first.groupBy(*LEVELS).agg(*mass, F.count("*").alias("rows")), "language-hosts")
    total = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in m)).first()
    wide = [(x + 1) / (sum(total) + len(langs)) for x in total]
    named = hosts.select(*LEVELS, "rows", *(F.col(m[k]).alias(f"host{k}") for k in count))
    above = hosts
    for depth, level in ((2, "domain"), (1, "suffix")):
        above = above.groupBy(*LEVELS[:depth]).agg(*(F.sum(c).alias(c) for c in m))
        named = named.join(above.withColumnsRenamed({m[k]: f"{level}{k}" for k in count}), list(LEVELS[:depth]))
    named = written(named, "language-levels")
    hot = named.where(F.col("rows") * HOT_SHARE > every)
    cold = named.where(F.col("rows") * HOT_SHARE <= every)
    joined = first.join(F.broadcast(hot), list(LEVELS)).unionByName(first.join(F.broadcast(hot.select(*LEVELS)), list(LEVELS), "left_anti").join(cold, list(LEVELS)))
    prior = [F.lit(w) for w in wide]
    for level in LEVELS:
        joined = joined.withColumns({f"{level}{k}": F.greatest(F.col(f"{level}{k}") - F.coalesce(p[k], F.lit(0.0)), F.lit(0.0)) for k in count})
        size = sum((F.col(f"{level}{k}") for k in count), F.lit(0.0))
        joined = joined.withColumn(f"n_{level}", size).withColumns({f"{level}_{k}": (F.col(f"{level}{k}") + STRENGTH * prior[k]) / (F.col(f"n_{level}") + STRENGTH) for k in count})
        prior = [F.col(f"{level}_{k}") for k in count]
    out = _with_posterior(joined.withColumns({s[k]: F.col(s[k]) + F.ln(prior[k]) for k in count}), s, p)
    best = F.greatest(*p) if len(p) > 1 else F.col(p[0])
    name = F.coalesce(*(F.when(F.col(p[k]) == best, F.lit(langs[k])) for k in count))
    return out.select("key", F.when(name != OTHER, name).alias("language"), best.alias("posterior"), F.coalesce((name != OTHER) & (best >= ACCEPT), F.lit(False)).alias("accepted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the lang column is the declaration, the source stands for a host."""
    return docs.select(F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))


def _unescaped(html: Column) -> Column:
    """References to the letters of ENTITIES in place; all others become blanks."""
    out = html
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(out, "&#?[0-9A-Za-z]{1,8};", " ")


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: text outside tags, the html tag's lang, and the parts of the address."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    return pages.select(F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("key"), _unescaped(plain).alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages: (doc_id, page_id, language, posterior, accepted), one of the ids null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs, "doc_id")
    parts = [identified(rows, model) for rows in (document_rows(docs), page_rows(pages))]
    key = F.substring("key", 2, 30).try_cast("long")
    return parts[0].unionByName(parts[1]).select(F.when(F.col("key").startswith("d"), key).alias("doc_id"), F.when(F.col("key").startswith("p"), key).alias("page_id"), "language", "posterior", "accepted")
