"""Writers, and manifests that make batch jobs restartable."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import exists

MANIFEST = "task string, status string, finished timestamp"


def write_columns(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.select(*columns).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_region(df: DataFrame, path: str, keys: tuple[str, ...] = ("tile_id", "subtile")) -> None:
    """Replaces only the partitions that df has (Spark leaves no _SUCCESS there, so one is set)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()


def write_rollup(df: DataFrame, path: str) -> None:
    """One CSV file with a header, ordered by country and year; a rollup is small by nature."""
    df.select("iso3_country", "begin_date", "end_date", "tCO2eq").orderBy("iso3_country", "begin_date").coalesce(1).write.mode("overwrite").csv(path, header=True)


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def log_tasks(tasks: DataFrame, path: str, status: str = "done") -> None:
    tasks.select(F.col("task"), F.lit(status).alias("status"), F.current_timestamp().alias("finished")).write.mode("append").parquet(path)


def pending(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that no manifest line names."""
    return tasks.join(done.select("task"), "task", "left_anti")


def write_attributes(spark: SparkSession, path: str, **attributes) -> None:
    """Provenance beside a table, as one JSON document."""
    spark.createDataFrame([(json.dumps(attributes, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.attributes")
