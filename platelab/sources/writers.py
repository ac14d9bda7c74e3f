"""Writers: sorted, resumable and sharded outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.session import checkpointed


def sorted_csv(rows: DataFrame, path: str, *order: Column) -> None:
    """CSV in order; quotes within values are doubled, as ``readers.csv`` and most programs expect."""
    rows.orderBy(*order).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def clustered(rows: DataFrame, path: str, *keys: str, partition: str | None = None) -> None:
    """Parquet whose files hold ranges of the keys, so that their statistics prune reads."""
    writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def pending(rows: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def _commits(spark: SparkSession, path: str):
    """The file system and the folder that has an empty file for each run that is done."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that have been committed."""
    files, folder = _commits(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def appended(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that committed runs of ``append_new`` have written, with their ``append_bucket``; none before the first."""
    done = runs(spark, path)
    if not done:
        return None
    # a run that had nothing to add has no files; the others tell the columns
    return spark.read.option("basePath", path).parquet(*[f"{path}/append_run={r}" for r in done]).drop("append_run")


def append_new(rows: DataFrame, path: str, *key: str, run: str | None = None, buckets: int = 64) -> None:
    """Append the rows whose key the output lacks; run again, it adds nothing.

    Rows are kept by buckets of their key's hash, and a run looks for its keys only in the buckets that they fall into,
    and there only at the key's columns. A run's rows count from when its commit file is there, so a run that fails, or
    is still writing, leaves nothing that is read; under the same name it starts afresh, or is skipped if it was done.
    """
    spark, run = rows.sparkSession, run or uuid.uuid4().hex
    if run in (done := runs(spark, path)):
        return
    own = checkpointed(rows.withColumn("append_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    if done:
        touched = [r[0] for r in own.select("append_bucket").distinct().collect()]  # at most ``buckets``
        own = pending(own, appended(spark, path).where(F.col("append_bucket").isin(touched)), *key)
    elif own.isEmpty():
        return
    own.repartition("append_bucket").write.mode("overwrite").partitionBy("append_bucket").parquet(f"{path}/append_run={run}")
    files, folder = _commits(spark, path)
    files.mkdirs(folder)
    files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, run)).close()


def sharded_json(rows: DataFrame, path: str, key: str, shards: int = 256) -> None:
    rows.withColumn("shard", F.pmod(F.col(key), F.lit(shards))).write.mode("overwrite").partitionBy("shard").json(path)


def manifest(rows: DataFrame, details: DataFrame, shards: int) -> DataFrame:
    """Counts of what was written."""
    return rows.agg(F.count("*").alias("n_dishes")).join(details.agg(F.count("*").alias("n_details"))).withColumn("n_shards", F.lit(shards))


def merge_shards(main: DataFrame, shards: list[DataFrame], wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Main rows win, then those of the first shard; also the wanted keys that none has."""
    every = main.withColumn("__from", F.lit(-1))
    for k, s in enumerate(shards):
        every = every.unionByName(s.withColumn("__from", F.lit(k)))
    first = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in main.columns if c != key]), "__from").alias("x")).select(key, "x.*")
    return first, wanted.join(first, key, "left_anti")
