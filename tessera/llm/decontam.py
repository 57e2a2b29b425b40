"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Documents and benchmark items are sequences of words: lower-case, in NFC, split at white space and ASCII
marks. A document is contaminated by an item if a run of its words is within floor(EDITS * m) word edits of the item's
m words.

* Screen. A run within k edits of m words shares at least m - 1 - 2k word pairs with it. Positions whose next
  m + k words hold fewer pairs of items of m words can't start a match and give no window; nothing else is
  left out. An item of one word has no pairs and is found wherever the word occurs.
* Embedding (Chakraborty, Goldenberg and Koucky, 2016). A walk of 3m steps copies the word it stands on and
  moves on if a random bit for (step, word) is set, so strings a few edits apart meet again soon and edit
  distance becomes Hamming distance.
* Bit sampling. Tables each read SAMPLED steps of one of the embeddings; item-sized windows are looked
  up among the items' embeddings. Their number follows, for each item length, from RECALL and from the collision
  rates measured, at start, on mutants with the most edits allowed: of each item one at least, of each length
  MUTANTS at least. Where more than MOST_TABLES were needed, a length has none: there the items that share enough
  word pairs with screened windows are all verified, which leaves no match out.
* Verification. Each candidate is aligned exactly with the words around its window (Myers' bit vectors), so
  every match returned is true.

The benchmark is a stated query set. It is read in blocks of at most BLOCK_BYTES of text, each broadcast and
held against all documents, so what is broadcast stays bounded for any benchmark.

Defined results: null or empty texts and items match nothing; an item of fewer than three words must occur
exactly; equal items each match; repeated document rows each give their matches; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, table

EDITS, RECALL, SAMPLED, EMBEDDINGS = 0.2, 0.999, 5, 8
MOST_TABLES, MUTANTS = 256, 256
BLOCK_BYTES = 8 << 20
EMBEDDED_AT_ONCE = 4096
SEED = 20


def allowed(m: int) -> int:
    return int(EDITS * m) if m >= 3 else 0


#: ASCII marks and control characters separate words, like white space.
_MARKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.encode().translate(_MARKS).split()


def best_alignment(item: list[int], run: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and a part of the run, and the part's end (the first of equals)."""
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(run.tolist(), 1):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = score, j
    return best


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known, sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Index:
    """A block of items, embedded and hashed."""

    def __init__(self, items: list[tuple[int, str]], recall: float = RECALL) -> None:
        split = [(i, words(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if w]
        numbers = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.number = numbers.get
        self.size = len(numbers) + 1
        self.codes = [np.array([numbers[w] for w in ws], np.int64) for _, ws in self.items]
        pairs = {int(p) for c in self.codes for p in self.pairs(c)}
        self.known = np.array(sorted(pairs), np.int64)
        #: A lone word has no pairs; items of one word are found where the word occurs.
        self.single: dict[int, list[int]] = {}
        for k, c in enumerate(self.codes):
            if len(c) == 1:
                self.single.setdefault(int(c[0]), []).append(k)
        self.lone = np.array(sorted(self.single), np.int64)
        self.lengths = sorted({len(c) for c in self.codes if len(c) > 1})
        self.known_of = {m: np.unique(np.concatenate([self.pairs(c) for c in self.codes if len(c) == m])) for m in self.lengths}
        #: Any match holds so many pairs within so many positions: the window of an item of m words consists of
        #: parts of this length, one of which holds its share.
        self.part = max(1, self.lengths[0] + allowed(self.lengths[0]) - 1) if self.lengths else 1
        self.share = min((-(-self.least(m) // -(-max(1, m + allowed(m) - 1) // self.part)) for m in self.lengths), default=1)
        self.random = np.random.default_rng(SEED)
        self.steps = 3 * max(self.lengths, default=1)
        self.bits = self.random.integers(0, 2, (EMBEDDINGS, self.steps, self.size + 1), np.uint8)
        self.mixers = self.random.integers(1, 1 << 62, SAMPLED, np.int64) | 1
        members: dict[int, list[int]] = {m: [] for m in self.lengths}
        for k, c in enumerate(self.codes):
            if len(c) > 1:
                members[len(c)].append(k)
        #: For each length: the tables, 0 where all screened windows are verified.
        self.tables = {m: self.tables_needed(m, [self.codes[k] for k in own], recall) for m, own in members.items()}
        #: For each length: the embedding and the steps that each table reads.
        self.reads = {m: [(t % EMBEDDINGS, np.sort(self.random.choice(3 * m, min(SAMPLED, 3 * m), replace=False))) for t in range(n)] for m, n in self.tables.items()}
        self.lookup: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        #: For lengths without tables: word pairs and the items that hold each.
        self.holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m, own in members.items():
            if not self.tables[m]:
                held = np.unique(np.concatenate([np.stack([p, np.full(len(p), k)], axis=1) for k in own for p in [self.pairs(self.codes[k])]]), axis=0)
                self.holders[m] = self.known_of[m], np.searchsorted(held[:, 0], np.append(self.known_of[m], np.iinfo(np.int64).max)), held[:, 1]
                continue
            hashed = self.hashes(np.stack([self.codes[k] for k in own]), m)
            self.lookup[m] = []
            for column in hashed:
                found: dict[int, list[int]] = {}
                for k, h in zip(own, column.tolist(), strict=True):
                    found.setdefault(h, []).append(k)
                self.lookup[m].append((np.array(sorted(found), np.int64), found))

    @staticmethod
    def least(m: int) -> int:
        """The fewest pairs that a run shares with an item of m words that it matches."""
        return max(1, m - 1 - 2 * allowed(m))

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """Neighbouring words as numbers; below 0 where one is in no item."""
        left, right = codes[..., :-1], codes[..., 1:]
        return np.where((left > 0) & (right > 0), left * self.size + right, -1)

    def embed(self, windows: np.ndarray, m: int) -> np.ndarray:
        """EMBEDDINGS walks over each row, 3m steps; past the end they copy a word of their own."""
        count = len(windows)
        end = np.full((count, 1), self.size, np.int64)
        flat = np.concatenate([windows, end], axis=1).ravel()
        first = np.tile(np.arange(count) * (m + 1), EMBEDDINGS)
        which = np.repeat(np.arange(EMBEDDINGS), count)
        at = np.zeros(len(first), np.int64)
        out = np.empty((3 * m, len(first)), np.int64)
        for j in range(3 * m):
            out[j] = flat[first + at]
            at = np.minimum(at + self.bits[which, j, out[j]], m)
        return out.reshape(3 * m, EMBEDDINGS, count)

    def hashes(self, windows: np.ndarray, m: int) -> np.ndarray:
        """A row of hashes for each table."""
        out = np.empty((self.tables[m], len(windows)), np.int64)
        for low in range(0, len(windows), EMBEDDED_AT_ONCE):
            walks = self.embed(windows[low : low + EMBEDDED_AT_ONCE], m)
            for t, (e, steps) in enumerate(self.reads[m]):
                out[t, low : low + EMBEDDED_AT_ONCE] = (walks[steps, e] * self.mixers[: len(steps), None]).sum(axis=0)
        return out

    def tables_needed(self, m: int, own: list[np.ndarray], recall: float) -> int:
        """How many tables find a share recall of mutants of the items of m words; 0 if more than MOST_TABLES.

        A table of one embedding finds a mutant at the rate of its best screened window near the start (a bound from
        below, as others may find it too). The chance that all miss it follows for each mutant, and its mean over mutants is the loss."""
        if not (k := allowed(m)):
            return 1
        rng, missed = random.Random(SEED + m), []
        count = max(len(own), MUTANTS)
        shifts = np.arange(max(-k, -2), min(k, 2) + 1)
        at_once = max(1, EMBEDDED_AT_ONCE * 32 // (m * len(shifts)))
        for low in range(0, count, at_once):
            items, runs = [], []
            for c in (own[i % len(own)] for i in range(low, min(low + at_once, count))):
                w = c.tolist()
                for _ in range(k):
                    at, kind = rng.randrange(len(w)), rng.randrange(3)
                    w[at : at + (kind != 1)] = [] if kind == 0 else [0]
                items.append(c)
                runs.append([0] * k + w + [0] * (m + 2 * k - len(w)))
            placed = np.array(runs, np.int64)
            hits = np.cumsum(np.pad(_in(self.pairs(placed), self.known_of[m]), ((0, 0), (1, 0))), axis=1)
            kept = hits[:, k + shifts + m + k - 1] - hits[:, k + shifts] >= self.least(m)
            windows = np.lib.stride_tricks.sliding_window_view(placed, m, axis=1)[:, k + shifts].reshape(-1, m)
            walks = self.embed(windows, m).reshape(3 * m, EMBEDDINGS, len(items), len(shifts))
            same = ((walks == self.embed(np.stack(items), m)[..., None]).mean(axis=0) * kept).max(axis=2)
            missed.append(np.log1p(-np.minimum(same**SAMPLED, 1 - 1e-12)).mean(axis=0))
        logs = np.concatenate(missed)
        for tables in range(EMBEDDINGS, MOST_TABLES + 1, EMBEDDINGS):
            if np.exp(tables * logs).mean() <= 1 - recall:
                return tables
        return 0

    def screened(self, text: str | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """A text's words as numbers, and for each item length the positions where a match may start."""
        found = words(text)
        codes = np.fromiter(map(self.number, found, itertools.repeat(0)), np.int64, len(found))
        out: dict[int, np.ndarray] = {}
        if len(codes) < 2 or not self.lengths:
            return codes, out
        pairs = self.pairs(codes)
        hits = np.concatenate([[0], np.cumsum(_in(pairs, self.known))])
        if hits[-1] < self.share or (len(hits) > self.part and (hits[self.part :] - hits[: -self.part]).max() < self.share):
            return codes, out
        places = np.arange(len(hits) - 1)
        for m in self.lengths:
            k, least = allowed(m), self.least(m)
            if hits[-1] >= least:
                last = np.minimum(places + max(1, m + k - 1), len(places))
                near = np.flatnonzero(hits[last] - hits[:-1] >= least)
                if not len(near):
                    continue
                low, high = int(near[0]), int(last[near[-1]])  # all that such windows hold
                own = np.concatenate([[0], np.cumsum(_in(pairs[low:high], self.known_of[m]))])
                starts = near[own[last[near] - low] - own[near - low] >= least]
                if len(starts):
                    out[m] = starts
        return codes, out

    def sharing(self, run: np.ndarray, m: int) -> list[int]:
        """The items of m words that share as many word pairs with the run as a match does."""
        known, starts, items = self.holders[m]
        pairs = self.pairs(run)
        rows = np.searchsorted(known, pairs[_in(pairs, known)])
        if not len(rows):
            return []
        count = np.bincount(np.concatenate([items[starts[r] : starts[r + 1]] for r in rows]))
        return np.flatnonzero(count >= self.least(m)).tolist()

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text's place, item_id, edits, start word, end word) of each text and item that match, at the best
        place. The windows of all texts are embedded together."""
        found = [self.screened(t) for t in texts]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, (codes, _) in enumerate(found):
            if len(self.lone) and len(codes):
                at = np.flatnonzero(_in(codes, self.lone))
                for word, first in zip(*np.unique(codes[at], return_index=True), strict=True):
                    best |= {(doc, item): (0, int(at[first]), int(at[first]) + 1) for item in self.single[int(word)]}
        for m in self.lengths:
            k, own, windows, places, spans = allowed(m), [], [], {}, {}
            for doc, (codes, starts) in enumerate(found):
                if m in starts and m in self.holders:
                    for low, high in _merged(starts[m].tolist(), m + k):
                        for item in self.sharing(codes[low : high + m + k], m):
                            spans.setdefault((doc, item), []).append((low, high))
                elif m in starts:
                    padded = np.concatenate([codes, np.full(m, self.size, np.int64)])
                    windows.append(np.lib.stride_tricks.sliding_window_view(padded, m)[starts[m]])
                    own += [(doc, int(s)) for s in starts[m]]
            if own:
                for (keys, table_), column in zip(self.lookup[m], self.hashes(np.concatenate(windows), m), strict=True):
                    for row in np.flatnonzero(_in(column, keys)):
                        for item in table_[int(column[row])]:
                            places.setdefault((own[row][0], item), set()).add(own[row][1])
            spans |= {key: _merged(sorted(where), m + k) for key, where in places.items()}
            for (doc, item), where in spans.items():
                codes = found[doc][0]
                for low, high in where:
                    first = max(0, low - k)
                    edits, stop = best_alignment(self.codes[item].tolist(), codes[first : high + m + k])
                    if edits <= k and ((doc, item) not in best or (edits, first + stop) < (best[doc, item][0], best[doc, item][2])):
                        best[doc, item] = edits, max(0, first + stop - m), first + stop
        return sorted((doc, self.items[item][0], *b) for (doc, item), b in best.items())


def _merged(starts: list[int], reach: int) -> list[tuple[int, int]]:
    """Runs of starts that lie within reach of each other."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s - out[-1][1] <= reach:
            out[-1] = out[-1][0], s
        else:
            out.append((s, s))
    return out


@functools.lru_cache(2)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(list(items))


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of about BLOCK_BYTES."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word, end_word) of each document and item that match."""
    context, out = docs.sparkSession.sparkContext, None
    schema = "doc_id long, item_id long, edits int, item_words int, start_word int, end_word int"
    for block in blocks(benchmark):
        sent = context.broadcast(tuple(sorted((r["item_id"], r["text"]) for r in block.collect())))

        def kernel(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch | None:
            index = _index(sent.value)
            size = {i: len(w) for i, w in index.items}
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], i, e, size[i], a, z) for d, i, e, a, z in index.matches(batch.column(1).to_pylist())]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.int32()] * 4], strict=True)], [c.split()[0] for c in schema.split(", ")]) if rows else None

        found = arrow_map(docs.select("doc_id", "text"), kernel, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    context, names = docs.sparkSession.sparkContext, docs.columns
    at = names.index("text")
    out = docs.toDF(*(f"c{k}" for k in range(len(names))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    for block in blocks(benchmark):
        sent = context.broadcast(tuple(sorted((r["item_id"], r["text"]) for r in block.collect())))

        def kernel(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            hit = {m[0] for m in _index(sent.value).matches(batch.column(at).to_pylist())}
            return batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        out = arrow_map(out, kernel, schema)
    return out.toDF(*names)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
