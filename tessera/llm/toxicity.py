"""Toxicity by a classifier chain of linear models.

The chain's categories come in order; the logistic model of each sees the words of a text and the
probabilities of the categories before it. In training those are out-of-fold: for each fold of FOLDS, models
fitted on the other folds predict it, so a later model learns from probabilities as uncertain as those it
gets when scoring. The final models are fitted on all sampled rows. A category's threshold is the one of best
F1 on out-of-fold probabilities.

Features are case-folded words and their first PREFIX letters, present or not; the FEATURES most telling ones,
by the variance that a category's label explains, take part. The models are fitted on the driver on at most
SAMPLE labelled rows, those of the smallest hashes of doc_id; executors reduce each to its distinct features. Fitting
and scoring read every whole text.

Defined results: a null or empty text has the probabilities of the bare intercepts; labels that are null
aren't trained on; repeated label rows count each; without labels of both kinds a category's probability is
its share (0 without labels) and nothing is flagged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, table

SAMPLE, FEATURES, FOLDS, PREFIX = 4000, 1000, 5, 6
RIDGE, STEPS = 3.0, 120
_WORDS_KEPT = 200_000
#: Categories in the chain's order, as expressions over the labels table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic", "toxic_low_quality": "toxic * (1 - quality)"}


def features_of(word: str) -> tuple[str, ...]:
    word = word.casefold().strip(".,;:!?\"'()[]{}|#$%&*-_/\\")
    return (word, f"^{word[:PREFIX]}") if len(word) > PREFIX else (word,) if word else ()


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").split()) for f in features_of(w)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights, the intercept last: accelerated gradient with a fixed step."""
    ones = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(ones.shape[1], np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.0
    w[-1] = np.log(share / (1 - share)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return w
    y = y.astype(np.float32)
    v = np.random.default_rng(0).normal(size=ones.shape[1]).astype(np.float32)
    for _ in range(12):
        v = ones.T @ (ones @ (v / np.linalg.norm(v)))
    rate = np.float32(1 / (0.25 * np.linalg.norm(v) + RIDGE))
    look, last = w.copy(), w.copy()
    for step in range(STEPS):
        slope = ones.T @ (sigmoid(ones @ look) - y)
        slope[:-1] += RIDGE * look[:-1]
        w = look - rate * slope
        look = w + np.float32(step / (step + 3)) * (w - last)
        last = w
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    at = int(f1.argmax())
    return float((p[order][at] + p[order][at + 1]) / 2) if at + 1 < len(y) else float(p[order][at])


class Chain:
    """Weights over the vocabulary, then over the earlier categories' probabilities, then the intercept."""

    def __init__(self, found: list[set[str]], labels: np.ndarray, folds: np.ndarray) -> None:
        """found: the distinct features of each text."""
        df: dict[str, np.ndarray] = {}
        for row, names in zip(labels, found, strict=True):
            count = np.append(row, 1)
            for name in names:
                if name in df:
                    df[name] += count
                else:
                    df[name] = count.copy()
        often = sorted(name for name, c in df.items() if c[-1] >= 3)
        n, share = max(1, len(found)), labels.mean(axis=0) if len(labels) else np.zeros(labels.shape[1])
        counts = np.array([df[name] for name in often]).reshape(len(often), labels.shape[1] + 1)
        told = (counts[:, :-1] - counts[:, -1:] * share) ** 2 / (counts[:, -1:] * (1 - counts[:, -1:] / (n + 1)) + 1) if len(often) else np.zeros((0, labels.shape[1]))
        score = (told / (share * (1 - share) + 1e-9)).max(axis=1) if len(often) else np.zeros(0)
        kept = sorted(np.argsort(-score, kind="stable")[:FEATURES].tolist())
        self.numbers = {often[k]: i for i, k in enumerate(kept)}
        x = np.zeros((len(found), len(kept)), np.float32)
        for row, names in enumerate(found):
            x[row, [self.numbers[f] for f in names if f in self.numbers]] = 1
        self.weights, self.thresholds, self.out_of_fold = [], [], np.zeros((len(found), 0), np.float32)
        for y in labels.T.astype(float):
            both = np.concatenate([x, self.out_of_fold], axis=1)
            p = np.zeros(len(y))
            for fold in range(FOLDS):
                held = folds == fold
                w = fit(both[~held], y[~held])
                p[held] = sigmoid(both[held] @ w[:-1] + w[-1])
            self.out_of_fold = np.concatenate([self.out_of_fold, p[:, None].astype(np.float32)], axis=1)
            self.weights.append(fit(both, y))
            self.thresholds.append(best_threshold(p, y) if len(y) and y.min() < y.max() else 2.0)

    def scorer(self) -> Scorer:
        return Scorer(self.numbers, self.weights, self.thresholds)


class Scorer:
    def __init__(self, numbers: dict[str, int], weights: list[np.ndarray], thresholds: list[float]) -> None:
        self.numbers, self.weights, self.thresholds = numbers, weights, thresholds
        self.size = len(numbers)
        self.table = np.stack([w[: self.size] for w in weights])
        self.seen: dict[str, tuple[int, ...]] = {}

    def known(self, words: set[str]) -> list[int]:
        out: set[int] = set()
        seen, numbers = self.seen, self.numbers
        for w in words:
            if (found := seen.get(w)) is None:
                if len(seen) >= _WORDS_KEPT:
                    seen.clear()
                found = seen[w] = tuple(numbers[f] for f in features_of(w) if f in numbers)
            if found:
                out.update(found)
        return sorted(out)

    def score(self, text: str | None) -> list[float]:
        base = self.table[:, self.known(set((text or "").split()))].sum(axis=1)
        p: list[float] = []
        for k, w in enumerate(self.weights):
            p.append(float(sigmoid(base[k] + w[self.size : -1] @ np.array(p) + w[-1])))
        return p


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    named = labels.select("doc_id", *(F.expr(e).cast("int").alias(f"y{k}") for k, e in enumerate(categories.values()))).dropna()
    taken = named.orderBy(F.xxhash64("doc_id"), *named.columns).limit(sample)
    own = [f"y{k}" for k in range(len(categories))]
    joined = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"), *own)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([sorted(text_features(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        return pa.record_batch([batch.column(0), batch.column(2), found, *batch.columns[3:]], ["doc_id", "h", "found", *own])

    rows = arrow_map(joined, kernel, "doc_id long, h string, found array<string>, " + ", ".join(f"{c} int" for c in own)).orderBy(F.xxhash64("doc_id"), "h", *own).limit(sample).collect()
    y = np.array([r[3:] for r in rows], np.int64).reshape(len(rows), len(categories))
    fold = np.array([(r["doc_id"] * 0x9E3779B97F4A7C15 >> 32) % FOLDS for r in rows], np.int64)
    return Chain([set(r["found"]) for r in rows], y, fold)


def scored(docs: DataFrame, chain: Chain, categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...)."""
    sent, names = docs.sparkSession.sparkContext.broadcast(chain.scorer()), list(categories)
    schema = "doc_id long, " + ", ".join([f"p_{n} double" for n in names] + [f"is_{n} boolean" for n in names])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = sent.value
        p = np.array([scorer.score(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(names))
        flags = p >= np.array(scorer.thresholds)
        return pa.record_batch([batch.column(0), *(pa.array(c) for c in p.T), *(pa.array(c) for c in flags.T)], [c.split()[0] for c in schema.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), kernel, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
