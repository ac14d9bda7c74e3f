"""Readers with explicit schemas; bad rows are skipped where the data say so."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet with only the columns asked for."""
    x = spark.read.parquet(path)
    return x.select(*columns) if columns else x


def jdbc(spark: SparkSession, url: str, name: str, *columns: str, **options: str) -> DataFrame:
    """A table of a database; filters and columns go to it."""
    x = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return x.select(*columns) if columns else x


def csv(spark: SparkSession, path: str, schema: dict[str, str], required: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """CSV with a header: the wanted columns are parsed as text and cast, and rows whose required columns do not cast
    are skipped. ``path`` may be a pattern over many files. Files are split between tasks unless values may hold line
    breaks (``multi_line``), which makes each file one task."""
    x = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return x.select(*[F.col(c).try_cast(t).alias(c) for c, t in schema.items()]).dropna(subset=list(required) or None, how="any" if required else "all")


def jsonl(spark: SparkSession, path: str, schema: str, skip_errors: bool = False) -> DataFrame:
    """Lines of JSON; lines that are no JSON are skipped, and on demand records with an ``error``."""
    x = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return x.where(F.coalesce("error", F.lit("")) == "") if skip_errors else x


def keyed(rows: DataFrame, key: str, names: dict[str, str], order: str) -> DataFrame:
    """Key and renamed columns, the last row of each key in ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, *[F.col(old).alias(new) for new, old in names.items()])


def vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """A vector index: the key stands beside each vector, row order means nothing."""
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias("vector"))


def sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One sheet of a workbook of bounded size, read on the driver; needs a library for workbooks."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=name, dtype=str))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """What is at ``path``, built and written there first if nothing is."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)
