"""Candidates for queries that arrive as a stream, looked up in a static index.

The index's term weights are a written table, partitioned by term; each micro-batch joins its terms with it and
keeps the best k per query. Nothing is kept between batches, so there is no state to watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import bm25
from tessera.session import written


def static_index(index: DataFrame) -> DataFrame:
    """All term weights of the index (i_id, toks), as a table."""
    terms = index.select(F.explode(F.array_distinct("toks")).alias("tok")).distinct()
    return written(bm25.term_weights(index, terms), "term-weights")


def looked_up(batch: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(q_id, i_id, score, rk) of a batch (q_id, toks)."""
    terms = batch.select("q_id", F.explode(F.array_distinct("toks")).alias("tok"))
    return bm25.ranked(terms.join(weights, "tok"), k)


def candidate_stream(queries: DataFrame, weights: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's candidates to Parquet below path, a folder for each batch, so a batch that is run again
    replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        looked_up(batch, weights, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
