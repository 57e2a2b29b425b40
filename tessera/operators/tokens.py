"""Token families: document frequencies, rarest tokens, n-grams."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a task counts before it passes their numbers on, and those whose frequencies every task is given.
COUNTED, MOST_FREQUENT = 250_000, 100_000
#: Rows that a kernel makes at a time.
MADE = 65_536


@dataclass(frozen=True)
class Words:
    """Where kernels find the tokens of a row: its columns, and a function of their values with a set of tokens for each family."""

    columns: tuple[str, ...]
    families: tuple[str, ...]
    sets: Callable[..., tuple[set[str], ...]]


def _sets(*lists: list[str | None] | None) -> tuple[set[str], ...]:
    return tuple(set(x or ()) - {"", None} for x in lists)


def of_arrays(families: tuple[str, ...]) -> Words:
    """Families that are array columns."""
    return Words(families, families, _sets)


def frequencies(records: DataFrame, part: str, words: Words) -> DataFrame:
    """(part, family, tok, df): how many records of the partition have the token, of those in two or more. Tasks count
    what they read and pass on numbers, so no row is made for a record's token."""
    kind = records.schema[part].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (p, family), own in counts.items():
                n = len(own)
                yield pa.record_batch([pa.array([p] * n, own_type), pa.array([family] * n, pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], [part, "family", "tok", "n"])
            counts.clear()

        own_type, held = pa.string(), 0
        for batch in batches:
            own_type = batch.schema.field(0).type
            for p, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for family, toks in zip(words.families, words.sets(*values), strict=True):
                    if (own := counts.get((p, family))) is None:
                        own = counts[p, family] = Counter()
                    own.update(toks)
                    held += len(toks)
                if held > COUNTED:  # a bound of what is held, then its size
                    if (held := sum(map(len, counts.values()))) > COUNTED:
                        yield from passed()
                        held = 0
        yield from passed()

    counted = records.select(part, *words.columns).mapInArrow(kernel, f"`{part}` {kind}, family string, tok string, n long")
    return counted.groupBy(part, "family", "tok").agg(F.sum("n").alias("df")).where("df >= 2")


def frequent(df: DataFrame, most: int | None = None) -> dict[tuple, dict[str, int]]:
    """{(part, family): {tok: df}} of the tokens whose df reaches a power of two, the least with at most so many
    of them, or MOST_FREQUENT."""
    at, least = F.floor(F.log2("df")).cast("int"), 0
    sizes = {r["b"]: r["n"] for r in df.groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()}
    while sum(n for b, n in sizes.items() if b >= least) > (MOST_FREQUENT if most is None else most):
        least += 1
    out: dict[tuple, dict[str, int]] = {}
    for batch in df.where(at >= least).toArrow().to_batches(16_384):
        for p, family, tok, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault((p, family), {})[tok] = n
    return out


def contenders(records: DataFrame, keep: list[str], words: Words, ranks: dict[str, int], known: dict[tuple, dict[str, int]]) -> DataFrame:
    """(keep, family, tok): of each record the tokens that may be among the ranks[family] rarest: all whose df isn't known,
    and as many of the others, by df and token. keep: the partition and what else names a record."""
    order = {key: sorted(own, key=lambda t, own=own: (own[t], t)) for key, own in known.items()}
    sent, n = records.sparkSession.sparkContext.broadcast(order), len(keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {key: {t: k for k, t in enumerate(own)} for key, own in sent.value.items()}
        for batch in batches:
            at, families, out = [], [], []

            def made(batch=batch, at=at, families=families, out=out) -> pa.RecordBatch:
                named = batch.select(range(n)).take(pa.array(at, pa.int64()))
                return pa.record_batch([*named.columns, pa.array(families, pa.string()), pa.array(out, pa.string())], [*keep, "family", "tok"])

            for k, (p, *values) in enumerate(zip(*(c.to_pylist() for c in [batch.column(0), *batch.columns[n:]]), strict=True)):
                for family, toks in zip(words.families, words.sets(*values), strict=True):
                    own, most, before = rank.get((p, family), {}), ranks[family], len(out)
                    out += toks.difference(own)
                    if most and len(out) - before < len(toks):
                        names = sent.value[p, family]
                        out += [names[r] for r in heapq.nsmallest(most, [own[t] for t in toks if t in own])]
                    families += [family] * (len(out) - before)
                    at += [k] * (len(out) - before)
                if len(out) > MADE:
                    yield made()
                    for x in (at, families, out):
                        x.clear()
            yield made()

    schema = ", ".join([*(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep), "family string", "tok string"])
    return records.select(*keep, *(F.col(c).alias(f"_{c}") for c in words.columns)).mapInArrow(kernel, schema)


def token_rows(records: DataFrame, column: str, keys: list[str], first: int | None = None) -> DataFrame:
    """(keys, tok): distinct non-empty tokens of an array column, or of its first ones."""
    tokens = F.slice(column, 1, first) if first else F.col(column)
    return records.select(*keys, F.explode(F.array_distinct(F.filter(tokens, lambda t: t != ""))).alias("tok"))


def document_frequency(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, tok, df) of rows with distinct (record, token)."""
    return rows.groupBy(*(keys or []), "tok").agg(F.count("*").alias("df"))


def rarest_tokens(rows: DataFrame, df: DataFrame, k: int, record: str, least: int = 2, keys: list[str] | None = None) -> DataFrame:
    """The k rarest tokens of each record among those in at least `least` records; ties by the token's text."""
    w = Window.partitionBy(*(keys or []), record).orderBy("df", "tok")
    joined = rows.join(df, [*(keys or []), "tok"]).where(F.col("df") >= least)
    return joined.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def prefixed(words: Column, prefix: str) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(prefix), w))


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters; the text itself if it is shorter, none if empty. The characters are taken apart once, as
    a substring's place has to be counted from the start."""
    once = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    runs = F.get(F.transform(once, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))), F.lit(0))
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, runs).when(F.length(text) > 0, F.array(text)).otherwise(empty)
