"""Exact nearest neighbours within partitions by matrix products.

Both sides are packed into blocks of about BLOCK rows within a partition; each block of the index meets each block of
its partition's queries in an equi-join on (partition, block of the index), so a large partition is as many keys as it
has blocks. A task multiplies the blocks and keeps a running best k of each query over all that it sees; the partial
lists meet in a grouped top-k. Neither side passes through the driver or is held whole, and the result is exact. Ties
go to the lower id. The queries are a stated set, sent once for each block of the index; vectors of one partition have
one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

BLOCK = 4096
#: Queries whose lists a task holds at most; then it sends them and starts anew.
HELD = 1 << 16


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """(part, block, ids, vectors flattened, number of blocks) of rows (id, part, vector)."""
    named = rows.select(F.col(rows.columns[0]).alias("id"), F.col(rows.columns[1]).cast("string").alias("part"), F.col(rows.columns[2]).cast("array<float>").alias("v")).dropna()
    sizes = named.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    dealt = named.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    packed = dealt.groupBy("part", "block", "blocks").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    out = packed.select("part", "block", "blocks", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("vectors"))
    return out.toDF("part", *(f"{side}_{c}" for c in out.columns[1:]))


def _ids(values: pa.Scalar) -> np.ndarray:
    """Numbers as they are, texts in an array that sorts as they do."""
    out = values.values.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _best(k: int, exclude_self: bool):
    """Running best k of each query over pairs of blocks."""

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for ids, scores, found in held.values():
            keep = ~np.isneginf(scores)
            yield pa.record_batch([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(found[keep]), pa.array(scores[keep])], ["q_id", "i_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                part, block, q_ids, q, i_ids, i = (batch.column(c)[n] for c in range(6))
                name, q_ids, i_ids = (part.as_py(), block.as_py()), _ids(q_ids), _ids(i_ids)
                queries, index = (v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) for v, ids in ((q, q_ids), (i, i_ids)))
                scores = np.round(queries @ index.T, 6)
                ids = np.broadcast_to(i_ids, scores.shape)
                if exclude_self:
                    scores = np.where(ids == q_ids[:, None], -np.inf, scores)
                if len(i_ids) > k:  # all that tie with the k-th stay until the order by id
                    least = np.partition(scores, len(i_ids) - k, axis=1)[:, len(i_ids) - k]
                    some = (scores >= least[:, None]).any(axis=0)
                    scores, ids = scores[:, some], ids[:, some]
                if name in held:
                    scores, ids = np.concatenate([held[name][1], scores], axis=1), np.concatenate([held[name][2], ids], axis=1)
                order = np.lexsort((ids, -scores))[:, :k]
                scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
                held[name] = q_ids, scores, ids
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from sent(held)
                    held = {}
        yield from sent(held)

    return run


def top_k(query: DataFrame, index: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q_id, i_id, score, rk) of columns (id, part, vector) on both sides. With exclude_self, a
    query isn't its own neighbour."""
    i = written(_blocks(index, "i"), "index-blocks")
    spread = i.groupBy("part").agg(F.max("i_blocks").alias("i_blocks")).withColumn("i_block", F.explode(F.sequence(F.lit(0), F.col("i_blocks") - 1))).drop("i_blocks")
    q = _blocks(query, "q").join(spread, "part")
    met = q.join(i, ["part", "i_block"]).select("part", "q_block", "q_ids", "q_vectors", "i_ids", "i_vectors")
    out = met.mapInArrow(_best(k, exclude_self), f"q_id {query.dtypes[0][1]}, i_id {index.dtypes[0][1]}, score double")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "i_id")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
