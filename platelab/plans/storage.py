"""Queries through readers and writers: what is written to the shared folder is read again and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.operators import cleaning
from platelab.session import scratch
from platelab.sources import catalog, readers, writers

from . import inputs as I
from .registry import query


@query("dataset_paths", "SELECT r_name AS name, CASE r_name WHEN 'ASIA' THEN '/asia' WHEN 'EUROPE' THEN '/clean/eu/menus' ELSE concat('/clean/', r_name) END AS path FROM region")
def dataset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"clean": "/clean", "clean/ASIA": "/asia", "clean/EUROPE": "/clean/eu/menus"}
    names = [r["r_name"] for r in I.read(spark, sf_dir, "region").collect()]  # the catalog is a handful of names
    return spark.createDataFrame([(n, catalog.resolve(f"clean/{n}", places, "/root")) for n in names], "name string, path string")


@query("table_scan", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, f"{sf_dir}/part.parquet", "p_partkey", "p_name", "p_size").where("p_size > 25").select("p_partkey", "p_name")


@query("csv_scan", "SELECT p_partkey AS id, concat(p_name, ', \"', p_brand, '\"') AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS size, p_retailprice AS price FROM part WHERE p_partkey % 7 <> 0")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.read(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE CAST(p_partkey AS STRING) END AS id", "concat(p_name, ', \"', p_brand, '\"') AS name", "CASE WHEN p_partkey % 5 = 0 THEN 'large' ELSE CAST(p_size AS STRING) END AS size", "p_retailprice AS price", "p_type AS unused"
    )
    path = scratch(spark)
    writers.sorted_csv(rows, path, F.col("name"))
    return readers.csv(spark, path, {"id": "long", "name": "string", "size": "int", "price": "double"}, ("id",))


@query("json_lines", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 6 NOT IN (0, 1)")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth of the lines is cut off, another sixth has an error."""
    whole = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 6 == 1, "timeout").otherwise("").alias("error")))
    path = scratch(spark)
    I.read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 6 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(path)
    return readers.jsonl(spark, path, "id long, name string, error string", skip_errors=True).select("id", "name")


@query("keyed_records", "SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS amount FROM events GROUP BY 1")
def keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.keyed(I.read(spark, sf_dir, "events"), "user_id", {"kind": "event_type", "amount": "value"}, "event_id")


@query("sharded_json", "SELECT o_orderkey % 16 AS shard, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def sharded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.sharded_json(I.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", 16)
    files = readers.jsonl(spark, path, "o_orderkey long, o_custkey long, shard long")
    return files.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


@query("shard_files", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 < 2")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three folders by a pattern over their names."""
    path = scratch(spark)
    I.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("chunk_"), F.col("p_partkey") % 3).alias("part")).write.partitionBy("part").option("header", True).csv(path)
    return readers.csv(spark, f"{path}/part=chunk_[01]", {"p_partkey": "long", "p_name": "string"})


@query("vector_scan", "SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings")
def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = readers.vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")
    return v.select("vec_id", F.size("vector").cast("long").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("parquet_cache", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def parquet_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    readers.cached(spark, path, lambda: I.read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")))
    return readers.cached(spark, path, lambda: spark.range(0).selectExpr("'' AS p_type", "id AS n"))  # what is there stays


@query("clustered_table", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def clustered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.clustered(I.read(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey"), path, "o_custkey", partition="o_orderstatus")
    return readers.table(spark, path, "o_orderstatus", "o_custkey", "o_orderkey").where("o_custkey BETWEEN 10 AND 40")


@query("resumed_append", "WITH k AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS least FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 1 ELSE 2 END AS run FROM lineitem JOIN k USING (l_orderkey, l_linenumber) WHERE l_quantity < 25 OR least >= 25")
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run adds only pairs of keys that the first left out."""
    rows, path = I.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), scratch(spark)
    key = ("l_orderkey", "l_linenumber")
    writers.append_new(rows.where("l_quantity < 25").select(*key, F.lit(1).alias("turn")), path, *key)
    writers.append_new(rows.select(*key, F.lit(2).alias("turn")), path, *key)
    return writers.appended(spark, path).select(*key, F.col("turn").alias("run"))


@query("output_manifest", "SELECT (SELECT count(*) FROM part) AS n_dishes, (SELECT count(*) FROM orders) AS n_details, 256 AS n_shards")
def output_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.manifest(I.read(spark, sf_dir, "part"), I.read(spark, sf_dir, "orders"), 256)


SHARDS = "main AS (SELECT p_partkey AS id, 'main' AS v FROM part WHERE p_partkey % 5 = 0), a AS (SELECT p_partkey AS id, 'a' AS v FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_partkey AS id, 'b' AS v FROM part WHERE p_partkey % 2 = 0)"


def _shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = I.read(spark, sf_dir, "part")
    of = lambda n, v: p.where(f"p_partkey % {n} = 0").select(F.col("p_partkey").alias("id"), F.lit(v).alias("v"))
    return writers.merge_shards(of(5, "main"), [of(3, "a"), of(2, "b")], p.select(F.col("p_partkey").alias("id")), "id")


@query("merged_shards", f"WITH {SHARDS} SELECT id, coalesce(main.v, a.v, b.v) AS v FROM main FULL JOIN a USING (id) FULL JOIN b USING (id)")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir)[0]


@query("missing_keys", "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir)[1]


@query(
    "pending_shards",
    f"WITH {SHARDS}, p AS (SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM main UNION ALL SELECT id FROM a UNION ALL SELECT id FROM b)) SELECT id, ((row_number() OVER (ORDER BY id) - 1) % 3)::INT AS shard FROM p",
)
def pending_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return cleaning.shard(writers.pending(p, _shards(spark, sf_dir)[0], "id"), [F.col("id")], 3)
