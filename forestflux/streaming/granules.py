"""Conversion of granule files as they arrive, with a status for each: skipped, converted or failed.

A stream hands over each file once. A batch writes its rows and then its statuses, each to a folder of its own that a repeated batch
overwrites; rows count only if their batch has statuses, so a batch that dies between the two leaves nothing behind when it is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import exists

STATUS = "path string, status string, message string"
#: What Spark tells of a file.
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Characters of an error that a status keeps.
MESSAGE = 500


def read_parquet_bytes(content: bytes) -> pa.Table:
    """The rows of a parquet file held in memory: the staging format, and the default parser."""
    import pyarrow.parquet as pq

    return pq.read_table(pa.BufferReader(content))


def statuses(spark: SparkSession, status: str) -> DataFrame:
    """All statuses (path, status, message, run), of every run."""
    return spark.read.schema(f"{STATUS}, run string").parquet(status) if exists(spark, status) else spark.createDataFrame([], f"{STATUS}, run string")


def converted(spark: SparkSession, target: str, status: str, schema: str) -> DataFrame:
    """Rows of the files that are converted; rows of batches that never got to their statuses are not among them."""
    if not exists(spark, target):
        return spark.createDataFrame([], f"{schema}, path string, run string")
    done = statuses(spark, status).where("status = 'converted'").select("run", "path")
    return spark.read.schema(f"{schema}, path string, run string").parquet(target).join(done, ["run", "path"], "left_semi")


def convert(files: DataFrame, run: str, target: str, status: str, schema: str, parse: Callable[[bytes], pa.Table] = read_parquet_bytes) -> None:
    """Converts files (path, content) under the name of a run; files converted by another run are skipped, and a broken file only fails itself."""
    spark = files.sparkSession
    names = spark.createDataFrame([], schema).columns
    known = statuses(spark, status).where((F.col("status") == "converted") & (F.col("run") != run)).select("path").distinct()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = parse(content)
                    columns = [rows.column(n).cast(types.field(n).type).combine_chunks() for n in names]
                    outcome, message = "converted", None
                except Exception as e:  # whatever is wrong with a file is its status
                    columns, outcome, message = None, "failed", f"{type(e).__name__}: {e}"[:MESSAGE]
                n = len(columns[0]) if columns else 0
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, types.field(c).type) for c in names), pa.array([path]), pa.array([outcome]), pa.array([message], pa.string())], schema=types)
                if n:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * n), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"{schema}, {STATUS}"
    types = to_arrow_schema(spark.createDataFrame([], full).schema)
    staged = f"{target.rstrip('/')}/.staged/{run}"
    files.select("path", "content").join(known, "path", "left_anti").mapInArrow(parsed, full).write.mode("overwrite").parquet(staged)
    found = spark.read.schema(full).parquet(staged)
    found.where("status is null").select(*names, "path").write.mode("overwrite").parquet(f"{target.rstrip('/')}/run={run}")
    skipped = files.select("path").join(known, "path", "left_semi").select("path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("message"))
    found.where("status is not null").select("path", "status", "message").unionByName(skipped).write.mode("overwrite").parquet(f"{status.rstrip('/')}/run={run}")
    p = spark._jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ingest(spark: SparkSession, source: str, target: str, status: str, checkpoint: str, schema: str, parse: Callable[[bytes], pa.Table] = read_parquet_bytes, pattern: str = "*.parquet", files: int = 1000) -> StreamingQuery:
    """Converts what is new under source and stops: a batch is `files` files at most, and others than the pattern's don't count."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(source)

    def one(batch: DataFrame, number: int) -> None:
        convert(batch, f"batch-{number}", target, status, schema, parse)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(spark: SparkSession, target: str, status: str, schema: str, parse: Callable[[bytes], pa.Table] = read_parquet_bytes) -> int:
    """Reads those files again that have failed and not been converted since; returns how many."""
    all_ = statuses(spark, status)
    left = all_.where("status = 'failed'").select("path").distinct().join(all_.where("status = 'converted'").select("path"), "path", "left_anti")
    paths = [r.path for r in left.collect()]  # the broken ones
    if paths:
        number = all_.where("run like 'retry-%'").select("run").distinct().count()
        convert(spark.read.format("binaryFile").load(paths), f"retry-{number}", target, status, schema, parse)
    return len(paths)
