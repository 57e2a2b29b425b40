"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A node of the tree is a text with its exact segmentation and ids. Encoding splits a text in halves down to
LEAF_CHARS characters, encodes each and joins the neighbours:

* Segmentation. The pattern has no lookbehind, so a scan that starts at a true boundary needs nothing to
  its left; and a match examines at most LOOKAHEAD characters past its end, so pieces that end that far
  before the end of a text stay whatever follows. A join rescans a window from the first unstable piece of
  the left node into the right one, doubling it until a stable boundary of the window is one of the right
  node's own. From there on both scans agree, so all outside the window is proven to stand.
* Merging. A piece that is no token is itself halved, down to LEAF_BYTES bytes, which merge by rank. A sequence
  of tokens is the encoding of its bytes exactly if every adjacent pair encodes to itself, so a join re-encodes a
  window of tokens around the seam and widens either side until both its edge pairs are valid.

Decoding concatenates token bytes up the tree. No tokenizer library takes part; the tests hold one against this.

Defined results: a null text is the empty text, with no ids; rows are independent, so repeated rows and
ties get equal values; an empty table gives an empty result; columns other than those named are ignored.
Rows of a table hold whole texts of any length; a text is held by one task, as it is a single value.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters that the pattern examines past a match: "'" before "re", and a space before a word.
LOOKAHEAD = 2
#: A leaf's size in a text, in a piece and in a list of ids.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1024, 16, 512
#: Parts up to which a scan for the lowest rank beats a heap.
SCANNED = 48
_NONE = 1 << 62
#: Pieces remembered by a worker; when full, it starts anew.
CACHE_PIECES = 200_000


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


class _Pieces(dict):
    """Piece -> decimal ids joined by commas."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = ",".join(map(str, self.encode(piece.encode())))
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 2), max(leaf_bytes, 2)
        self.scan = regex.compile(pattern).findall
        #: The token that two tokens, packed in one number, merge into; a token's id is its rank.
        self.merged = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: i for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.bytes_of_text = {str(i): b for b, i in self.ranks.items()}
        self.pieces = _Pieces(self.encode_piece)
        self.split = functools.lru_cache(None)(self.last_merge)

    # Merging inside a piece

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties; a whole piece isn't looked up."""
        ids = [self.byte_ids[b] for b in data]
        return self.merge_by_heap(ids) if len(ids) > SCANNED else self.merge_ids(ids)

    def merge_ids(self, ids: list[int], least: int = 1) -> list[int]:
        """Merges neighbours, in place, until none can be or so many are left."""
        merged = self.merged.get
        lowest = [merged(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while len(ids) > least and (new := min(lowest)) != _NONE:
            i = lowest.index(new)
            del lowest[i], ids[i]
            ids[i] = new
            if i:
                lowest[i - 1] = merged(ids[i - 1] << 32 | new, _NONE)
            if i < len(lowest):
                lowest[i] = merged(new << 32 | ids[i + 1], _NONE)
        return ids

    def merge_by_heap(self, ids: list[int]) -> list[int]:
        """merge_ids() for long windows: a heap of (rank, place) over linked tokens, so n log n."""
        merged, n = self.merged.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(new, i) for i in range(n - 1) if (new := merged(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or merged(ids[i] << 32 | ids[j]) != new:
                continue  # one of the two has changed since
            ids[i], ids[j], k, h = new, -1, after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := merged(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if h >= 0 and (x := merged(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t in ids if t >= 0]

    def last_merge(self, token: int) -> tuple[int, ...]:
        """The two tokens that merge into this one last; none for a byte."""
        data = self.bytes_of[token]
        return () if len(data) == 1 else tuple(self.merge_ids([self.byte_ids[b] for b in data], 2))

    def valid(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes encode to just them. Merges are undone, the latest first (of equal ranks the
        right one, as the left one comes first); what stands at the seam then must not merge before it was merged away."""
        merged, until = self.merged.get, _NONE
        while True:
            if merged(a << 32 | b, _NONE) < until:
                return False
            x, y = self.split(a), self.split(b)
            if x and (a > b or not y):
                until, a = a, x[1]
            elif y:
                until, b = b + 1, y[0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern: whole if it is a token, else by the tree."""
        if len(data) <= self.longest and data in self.ranks:
            return [self.ranks[data]]
        return self.piece_tree(data)

    def piece_tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.piece_tree(data[:half]), self.piece_tree(data[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.valid(left[-1], right[0]):
            return left + right
        i, j = min(2, len(left)), min(2, len(right))
        while True:
            window = self.merge(b"".join(self.bytes_of[t] for t in [*left[len(left) - i :], *right[:j]]))
            ok_left = i == len(left) or self.valid(left[-i - 1], window[0])
            ok_right = j == len(right) or self.valid(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if ok_left else min(2 * i, len(left))), (j if ok_right else min(2 * j, len(right)))

    # Segmentation of a text

    def segment(self, text: str) -> list[str]:
        """The pattern's matches over the text; the pattern matches every character."""
        if len(text) <= self.leaf_chars:
            return self.scan(text)
        half = len(text) // 2
        return self.join_pieces(self.segment(text[:half]), self.segment(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        keep, tail = len(left), 0
        while keep and tail < LOOKAHEAD:  # the pieces that end too near the seam, and the one before
            keep -= 1
            tail += len(left[keep])
        if keep:
            keep -= 1
        head = "".join(left[keep:])
        j = 4
        while True:
            j = min(j, len(right))
            own, at = set(), len(head)
            for piece in right[:j]:
                own.add(at)
                at += len(piece)
            own.add(at)
            window = self.scan(head + "".join(right[:j]))
            if j == len(right):
                return left[:keep] + window
            end = 0
            for k, piece in enumerate(window):
                end += len(piece)
                if end + LOOKAHEAD > at:
                    break
                if end in own:
                    return left[:keep] + window[: k + 1] + self._after(right, end - len(head))
            j *= 2

    @staticmethod
    def _after(right: list[str], chars: int) -> list[str]:
        k = 0
        while chars > 0:
            chars -= len(right[k])
            k += 1
        return right[k:]

    # Whole texts

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.pieces.__getitem__, self.segment(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(",") if i]

    def decode(self, ids: list[int] | list[str]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map((self.bytes_of if ids and isinstance(ids[0], int) else self.bytes_of_text).__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return pa.record_batch([batch.column(0), pa.array([c.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    return arrow_map(docs.select(key, text), kernel, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return pa.record_batch([batch.column(0), pa.array([c.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], [key, "bytes"])

    return arrow_map(encoded.select(key, "ids"), kernel, f"{key} {dict(encoded.dtypes)[key]}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids and returns digests of both, and the ids if asked."""
    kinds = {"doc_id": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if with_ids:
        kinds["ids"] = ("array<int>", pa.list_(pa.int32()))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(path, pattern), []
        for t in batch.column(1).to_pylist():
            ids = c.encode_text(t or "")
            listed = ids.split(",") if ids else []
            row = len(listed), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decode(listed)).hexdigest()
            rows.append((*row, np.array(listed, dtype=str).astype(np.int32)) if with_ids else row)
        columns = [pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), list(kinds.values())[1:], strict=True)]
        return pa.record_batch([batch.column(0), *columns], list(kinds)) if rows else None

    return arrow_map(docs.select("doc_id", "text"), kernel, ", ".join(f"{n} {k}" for n, (k, _) in kinds.items()))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
