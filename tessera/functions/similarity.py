"""Similarities of pairs of texts, 0 to 1. Native where Spark has the parts; the rest are Arrow-batched, on
bit-parallel longest common subsequences. Missing scores are null, never NaN."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def levenshtein_similarity(a: Column, b: Column) -> Column:
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / size)


def capped_levenshtein(a: Column, b: Column, cap: int) -> Column:
    """cap + 1 where the distance is above the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, F.lit(cap + 1)).otherwise(d)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def guarded(a: Column, b: Column, score: Column, skip: Column | None = None) -> Column:
    """1 where the texts are equal, null where skipped, else the score."""
    out = F.when(a == b, F.lit(1.0)).otherwise(score)
    return out if skip is None else F.when(~skip, out)


class Text:
    """A text with what its scorers share, made when first needed."""

    __slots__ = ("_masks", "_ordered", "_words", "text")

    def __init__(self, text: str) -> None:
        self.text, self._masks, self._words, self._ordered = text, None, None, None

    @property
    def masks(self) -> dict[str, int]:
        if self._masks is None:
            self._masks = _masks(self.text)
        return self._masks

    @property
    def words(self) -> frozenset[str]:
        if self._words is None:
            self._words = frozenset(self.text.split())
        return self._words

    @property
    def ordered(self) -> str:
        if self._ordered is None:
            self._ordered = " ".join(sorted(self.text.split()))
        return self._ordered


def lcs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence (Hyyro's bit vectors). masks: those of a, if at hand; else what both
    begin and end with is common and left out first."""
    if not a or not b:
        return 0
    if masks is not None:
        return _common(masks, len(a), b)
    n = min(len(a), len(b))
    first = next((k for k in range(n) if a[k] != b[k]), n)
    last = next((k for k in range(n - first) if a[-1 - k] != b[-1 - k]), n - first)
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    return first + last + (_common(_masks(a), len(a), b) if a and b else 0)


def levenshtein_score(a: str, b: str) -> float:
    """levenshtein_similarity, outside of Spark (Myers' bit vectors, the shorter text's)."""
    size = max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    first = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    a, b = a[first:], b[first:]
    last = next((k for k in range(len(a)) if a[-1 - k] != b[-1 - k]), len(a))
    a, b = a[: len(a) - last], b[: len(b) - last]
    if not a:
        return 1 - len(b) / size if size else 1.0
    at, n = _masks(a), len(a)
    full, far = (1 << n) - 1, n
    up, down, get = full, 0, at.get
    for c in b:
        m = get(c, 0)
        x = m | down
        h = (((m & up) + up) ^ up) | m
        more, less = (down | ~(h | up)) & full, up & h
        far += (more >> (n - 1)) - (less >> (n - 1))
        more = more << 1 | 1
        up, down = (less << 1 | ~(x | more)) & full, more & x & full
    return 1 - far / size


def ratio(a: str, b: str, masks: dict[str, int] | None = None) -> float:
    return 1.0 if not a and not b else 2 * lcs(a, b, masks) / (len(a) + len(b))


def _masks(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    return at


def _common(at: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    row, get = full, at.get
    for c in b:
        if m := get(c):
            u = row & m
            row = (row + u) | (row - u)
            if row > full:
                row &= full
    return n - (row & full).bit_count()


def _best_prefix(at: dict[str, int], n: int, b: str) -> float:
    """Best ratio of a text of n characters, given by its masks, with the prefixes of b that are shorter: all in one pass."""
    full = (1 << n) - 1
    row, get, best = full, at.get, 0.0
    for k, c in enumerate(b[: n - 1], 1):
        if m := get(c):
            u = row & m
            row = ((row + u) | (row - u)) & full
            best = max(best, 2 * (n - row.bit_count()) / (n + k))
    return best


def _best_window(at: dict[str, int], n: int, b: str) -> int:
    """The most that a text of n characters, given by its masks, has in common with a window of n characters of b. The
    windows are lanes of one number, a bit apart for the carry, so a step serves them all; from step to step the lanes'
    masks move on by a lane."""
    windows, stride, full = len(b) - n + 1, n + 1, (1 << n) - 1
    every = full * (((1 << windows * stride) - 1) // ((1 << stride) - 1))
    row, get, last, masks = every, at.get, (windows - 1) * stride, 0
    for w in range(windows):
        if m := get(b[w]):
            masks |= m << w * stride
    for j in range(n):
        u = row & masks
        row = ((row + u) | (row - u)) & every
        masks >>= stride
        if j + 1 < n and (m := get(b[windows + j])):
            masks |= m << last
    least = n
    for _ in range(windows):
        least = min(least, (row & full).bit_count())
        row >>= stride
    return n - least


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows cut at its ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    if _lanes_bits(a, b) > LANES_BITS:
        return _combed([(a, b)])[0]
    at, n = _masks(a), len(a)
    return max(_best_window(at, n, b) / n, _best_prefix(at, n, b), _best_prefix(_masks(a[::-1]), n, b[::-1]))


#: Bits of all windows up to which they are lanes of one number; longer texts are combed.
LANES_BITS = 1 << 14
#: Characters of pairs that are combed side by side, one pair at least, and by how much the longest may exceed the shortest.
COMBED_CHARS, COMBED_SPREAD = 1 << 15, 1.25


def _lanes_bits(a: str, b: str) -> int:
    return (len(b) - len(a) + 1) * (len(a) + 1)


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio of each pair; long texts of like lengths are combed side by side."""
    out: list[float | None] = [None] * len(pairs)
    long = []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if a and _lanes_bits(a, b) > LANES_BITS and a not in b:
            long.append((len(b), len(a), k, a, b))
        else:
            out[k] = partial_ratio(a, b)
    for group in _alike(sorted(long)):
        for (_, _, k, _, _), best in zip(group, _combed([(a, b) for *_, a, b in group]), strict=True):
            out[k] = best
    return out


def _alike(long: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of (length, length of the shorter, ...), sorted, that are combed together."""
    group: list[tuple] = []
    for x in long:
        if group and ((len(group) + 1) * (x[0] + max(x[1], *(g[1] for g in group), 0)) > COMBED_CHARS or x[0] > COMBED_SPREAD * group[0][0]):
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def _codes(texts: list[str], pad: int, kind: type) -> np.ndarray:
    """Characters of texts, one a column, filled up with pad."""
    out = np.full((max(map(len, texts)), len(texts)), pad, kind)
    for k, t in enumerate(texts):
        out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _combed(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio of pairs (shorter, longer), exact in time by the product of lengths: Tiskin's semi-local common
    subsequences. Strands come from the rows of a and the columns of b; where two meet they cross if the characters are
    equal or they have crossed before. The strand that leaves b at r and entered it at s costs each window that holds both
    a character. Cells of an antidiagonal are independent, so a step takes one of all pairs. Padding equals nothing and
    changes no strand of the texts before it."""
    m, n, k = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs), len(pairs)
    wide = max(max(map(max, pair)) for pair in pairs) >= "\ufff0"
    kind, pads = (np.uint32, (0xFFFFFFFF, 0xFFFFFFFE)) if wide else (np.uint16, (0xFFFF, 0xFFFE))
    rows, columns = np.ascontiguousarray(_codes([a for a, _ in pairs], pads[0], kind)[::-1]), _codes([b for _, b in pairs], pads[1], kind)
    ids, high = (np.uint16, 15) if m + n < 1 << 15 else (np.uint32, 31)
    h = np.repeat(np.arange(m, dtype=ids)[:, None], k, 1)
    v = np.repeat(np.arange(m, m + n, dtype=ids)[:, None], k, 1)
    # one flat axis: a step's cells lie side by side
    rows, columns, h, v = (x.reshape(-1) for x in (rows, columns, h, v))
    same, mask = np.empty(m * k, np.bool_), np.empty(m * k, ids)
    for d in range(m + n - 1):
        first, last = max(0, d - m + 1), min(n, d + 1)
        at = m - 1 - d + first
        x, y = slice(at * k, (at + last - first) * k), slice(first * k, last * k)
        hs, vs, low, equal = h[x], v[y], mask[: (last - first) * k], same[: (last - first) * k]
        np.equal(rows[x], columns[y], out=equal)
        low[...] = equal
        np.left_shift(low, high, out=low)
        np.bitwise_or(low, hs, out=low)
        np.minimum(low, vs, out=low)  # the column's strand where characters are equal, else the lesser
        np.bitwise_xor(vs, hs, out=vs)
        np.bitwise_xor(vs, low, out=vs)
        hs[...] = low
    left = v.reshape(n, k).astype(np.int64) - m
    return [_best_of_strands(left[: len(b), j], len(a)) for j, (a, b) in enumerate(pairs)]


def _best_of_strands(entered: np.ndarray, m: int) -> float:
    """Best ratio of a text of m characters with windows of another, by where the strand that leaves it at each place has
    entered it; below 0 came from the text's rows. A window has in common its length less the strands within it."""
    n = len(entered)
    leaves, at = np.full(n, n), np.flatnonzero(entered >= 0)
    leaves[entered[at]] = at
    size = np.arange(1, m)
    heads = 2 * (size - np.cumsum(entered[: m - 1] >= 0)) / (m + size)
    tails = 2 * (size - np.cumsum(leaves[::-1][: m - 1] < n)) / (m + size)
    start = np.arange(n - m)
    within = np.count_nonzero(entered[:m] >= 0) + np.concatenate([[0], np.cumsum((entered[m:] > start).astype(np.int64) - (leaves[: n - m] < start + m))])
    return float(max((m - within.min()) / m, heads.max(initial=0.0), tails.max(initial=0.0)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words, and the common words with either side's rest; 0 if a side has none."""
    return set_ratio(frozenset(a.split()), frozenset(b.split()))


def set_ratio(s: frozenset[str], t: frozenset[str]) -> float:
    """token_set_ratio of sets of words. The common words lead both texts, so they are common to them as they are."""
    if not s or not t:
        return 0.0
    both = s & t
    if both and (len(both) == len(s) or len(both) == len(t)):
        return 1.0
    x, y = " ".join(sorted(s - both)), " ".join(sorted(t - both))
    n = sum(map(len, both)) + len(both)  # with the blank that follows
    best = 2 * (n + lcs(x, y)) / (2 * n + len(x) + len(y))
    return max(best, 2 * (n - 1) / (2 * n - 1 + min(len(x), len(y)))) if both else best


def jaro_winkler_score(a: str, b: str) -> float:
    """The prefix counts only above a Jaro similarity of 0.7."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    # places of a character in b, last first; those passed are used or out of reach for good
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    for i, c in enumerate(a):
        if own := places.get(c):
            while own and own[-1] < i - reach:
                own.pop()
            if own and own[-1] <= i + reach:
                used[own.pop()] = True
                left.append(c)
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(f):
    """An Arrow-batched function of two texts; null if one is null. Repeated pairs are scored once a batch."""

    @F.pandas_udf(DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        once = functools.lru_cache(None)(f)
        return pd.Series([None if x is None or y is None else once(x, y) for x, y in zip(a, b, strict=True)], dtype="object").astype("Float64")

    return scored


indel_ratio, indel_partial, indel_token_sort, indel_token_set, jaro_winkler = map(_pairwise, (ratio, partial_ratio, token_sort_ratio, token_set_ratio, jaro_winkler_score))

def _whole(a: Text, b: Text) -> float:
    return ratio(a.text, b.text, a.masks)


def _partial(a: Text, b: Text) -> float:
    return partial_ratio(a.text, b.text)


def _sorted(a: Text, b: Text) -> float:
    return ratio(a.ordered, b.ordered)


def _set(a: Text, b: Text) -> float:
    return set_ratio(a.words, b.words)


def _winkler(a: Text, b: Text) -> float:
    return jaro_winkler_score(a.text, b.text)


def _edits(a: Text, b: Text) -> float:
    return levenshtein_score(a.text, b.text)


#: Scores of a pair: name -> (function of two Texts, the parts compared).
SCORES = {
    "n_ratio": (_whole, "n_core", "n_core"), "n_pratio": (_partial, "n_core", "n_core"), "n_tsort": (_sorted, "n_core", "n_core"), "n_tset": (_set, "n_core", "n_core"),
    "n_jw": (_winkler, "n_core", "n_core"), "n_lev_full": (_edits, "n_full", "n_full"), "n_tset_full": (_set, "n_full", "n_full"),
    "n_concat_ratio": (_whole, "n_concat", "n_concat"), "n_concat_pratio": (_partial, "n_concat", "n_concat"),
    "n_skel_ratio": (_sorted, "n_skel", "n_skel"), "n_alias_a": (_set, "n_core", "n_alt_a"), "n_alias_b": (_set, "n_core", "n_alt_b"), "n_phon_ratio": (_set, "n_phon", "n_phon"),
    "a_ratio": (_whole, "a_full", "a_full"), "a_tsort": (_sorted, "a_full", "a_full"), "a_tset": (_set, "a_full", "a_full"), "a_pratio": (_partial, "a_full", "a_full"),
    "a_core_tset": (_set, "a_core", "a_core"), "a_alpha_tset": (_set, "a_alpha", "a_alpha"), "a_skel_ratio": (_set, "a_skel", "a_skel"),
}
#: Texts, and their characters, that a worker remembers; when full, it starts anew.
TEXTS_KEPT, CHARS_KEPT = 50_000, 4_000_000


class Scorer:
    """Scores of pairs of records, each text prepared once, each pair of texts scored once by a function until forget()."""

    def __init__(self) -> None:
        self.texts: dict[str, Text] = {}
        self.chars, self.once = 0, {}

    def forget(self) -> None:
        self.once = {}

    def of(self, text: str) -> Text:
        if (found := self.texts.get(text)) is None:
            if len(self.texts) >= TEXTS_KEPT or self.chars + len(text) > CHARS_KEPT:
                self.texts.clear()
                self.chars = 0
            found = self.texts[text] = Text(text)
            self.chars += len(text)
        return found

    def column(self, name: str, q: list[str], i: list[str], open_rows: list[bool]) -> list[float | None]:
        """The score where the row is open: 1 for equal texts, each pair of texts once."""
        f, of = SCORES[name][0], self.of
        once = self.once.setdefault(f, {})
        new = dict.fromkeys((a, b) for a, b, shown in zip(q, i, open_rows, strict=True) if shown and a != b and (a, b) not in once)
        once.update(zip(new, partial_ratios(list(new)) if f is _partial else [f(of(a), of(b)) for a, b in new], strict=True))
        return [None if not shown else 1.0 if a == b else once[a, b] for a, b, shown in zip(q, i, open_rows, strict=True)]
