"""Token counts by a linear longest-match automaton (Song et al., 2021).

The vocabulary's trie holds pieces that begin a word below one root and pieces that continue it below another.
Where no child fits, the failure link of a node leads to the node that the walk would reach after popping the
greedy longest pieces of what was read; the number of those pieces is computed in advance. So the greedy
longest-match count of a word takes one pass, a step or a link a character, and no piece is built.

Words are runs without white space. Defined results: a word that the greedy match can't cover is one unknown
token; a null or blank text has no words; a long word takes time linear in its length; repeated rows get equal
counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, table

VOCABULARY = "piece_bpe_32k.model"
BEGINS = "▁"
_WORDS_KEPT = 200_000
_NONE = -1


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in pieces if p.startswith(BEGINS) and len(p) > 1], [p for p in pieces if not p.startswith(BEGINS)]


class Automaton:
    def __init__(self, begin: Iterable[str], go_on: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        ends = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        ends.append(False)
                    node = self.children[node][c]
                if piece:
                    ends[node] = True
        self.link, self.popped = [_NONE] * len(ends), [0] * len(ends)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, count = self.link[u], self.popped[u]
                while z != _NONE and c not in self.children[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z != _NONE:
                    self.link[v], self.popped[v] = self.children[z][c], count

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if the greedy match can't cover it."""
        node, count, children, link, popped = 0, 0, self.children, self.link, self.popped
        for c in word:
            while (to := children[node].get(c)) is None:
                if link[node] == _NONE:
                    return 0
                count += popped[node]
                node = link[node]
            node = to
        while node != 1:
            if link[node] == _NONE:
                return 0
            count += popped[node]
            node = link[node]
        return count


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = value
        return value


@functools.lru_cache(2)
def counter(path: str) -> _Counts:
    return _Counts(Automaton(*vocabulary(path)))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown); an unknown word is one of the tokens."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, rows = counter(path).__getitem__, []
        for text in batch.column(1).to_pylist():
            words = (text or "").split()
            counts = np.fromiter(map(of, words), np.int64, len(words))
            unknown = len(words) - int(np.count_nonzero(counts))
            rows.append((len(words), int(counts.sum()) + unknown, unknown))
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_tokens", "n_unknown"]) if rows else None

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
