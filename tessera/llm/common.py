"""Reading tables, the shared scratch folder, and running Python kernels on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path, shared_dir, table, written

__all__ = ["arrow_map", "delete", "scratch_path", "shared_dir", "table", "written"]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """kernel over each Arrow batch; a batch holds at most spark.sql.execution.arrow.maxRecordsPerBatch rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = kernel(batch.slice(at, 512))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
