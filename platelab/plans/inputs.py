"""Menu-like inputs made from the driver's tables, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = """CASE p_partkey % 8 WHEN 0 THEN concat('#13 ', p_name, ' wraps') WHEN 1 THEN concat(p_size, ' pc. ', p_name, ' (spicy)') WHEN 2 THEN concat('The ', p_name, ' &amp;', CASE WHEN p_size % 2 = 0 THEN 'amp;' ELSE '' END, ' prawns')
 WHEN 3 THEN concat(p_name, ' 8 oz hamburger') WHEN 4 THEN concat('ten ', p_name, ' tenders') WHEN 5 THEN concat('A) ', p_name, ' w/bacon [vegan]') WHEN 6 THEN concat(p_name, ' of ', p_name, ' fettuccini') ELSE NULL END"""
CATEGORY = "CASE p_partkey % 6 WHEN 0 THEN 'Wraps' WHEN 1 THEN 'Hoagies' WHEN 2 THEN 'Burgers & Bowls' WHEN 3 THEN 'Drinks' WHEN 4 THEN 'Noodles' ELSE NULL END"
TAGS = "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Pizza, Bar' WHEN 2 THEN 'Grocery' WHEN 3 THEN ' Burgers ,Grocery' ELSE 'Sandwiches, Thai' END"
SYNONYMS = {"fettuccini": "fettuccine", "hamburger": "burger", "hoagie": "sub", "prawns": "shrimp"}
EXCLUDED_TAGS = ("Grocery",)
MENU_SQL = f"(SELECT p_partkey AS id, p_partkey % 100 AS restaurant_id, {CATEGORY} AS category, {NAME} AS name, p_retailprice AS price_usd FROM part)"
RESTAURANT_SQL = f"(SELECT s_suppkey AS id, s_name AS name, {TAGS} AS category FROM supplier)"
#: Names of clusters and how often they occur.
CLUSTER_NAME = "CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' ', p_size % 3, ' pcs') WHEN 1 THEN concat('w ', p_name) WHEN 2 THEN concat(p_name, ' sub') WHEN 3 THEN concat(p_name, ' sandwich') WHEN 4 THEN concat(p_name, ' ', p_name, ' deluxe') WHEN 5 THEN concat(p_name, ' hoagie combo') WHEN 6 THEN concat('by ', p_name) WHEN 7 THEN split_part(p_name, ' ', 2) ELSE p_name END"
CLUSTER_SQL = f"(SELECT row_number() OVER (ORDER BY canonical_name) AS cluster_id, canonical_name, total_count FROM (SELECT {CLUSTER_NAME} AS canonical_name, count(*) AS total_count FROM part GROUP BY 1) x)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 100 AS restaurant_id", f"{CATEGORY} AS category", f"{NAME} AS name", "p_retailprice AS price_usd")


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", f"{TAGS} AS category")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    names = read(spark, sf_dir, "part").selectExpr(f"{CLUSTER_NAME} AS canonical_name").groupBy("canonical_name").agg(F.count("*").alias("total_count"))
    return names.select(F.row_number().over(Window.orderBy("canonical_name")).cast("long").alias("cluster_id"), "canonical_name", "total_count")


def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recipes, lines as ingredients; parts of one kind are unknown to the factor table."""
    li = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS recipe_id", "CAST(l_linenumber AS INT) AS position", "l_partkey", "l_quantity AS grams")
    names = read(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "concat(p_name, ' ', p_size % 7) AS ingredient")
    return li.join(names, "l_partkey").drop("l_partkey")


ROWS_SQL = "(SELECT l_orderkey AS recipe_id, CAST(l_linenumber AS INT) AS position, concat(p_name, ' ', p_size % 7) AS ingredient, l_quantity AS grams FROM lineitem JOIN part ON l_partkey = p_partkey)"


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by ingredient name; names of rods are missing, and water of hot ones."""
    return read(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_size % 7) AS ingredient", "p_name", "p_retailprice", "p_size").where("p_name NOT LIKE '%rod'").groupBy("ingredient").agg(
        *_sums()
    )


def _sums():
    from pyspark.sql import functions as F

    size = F.max(F.when(~F.col("p_name").startswith("hot"), F.col("p_size") + 2))
    return [F.sqrt(F.max("p_retailprice")).alias("ghg"), F.sqrt(size).alias("water"), F.sqrt(F.max("p_size") + 3).alias("land")]


FACTORS_SQL = "(SELECT ingredient, sqrt(max(p_retailprice)) AS ghg, sqrt(max(CASE WHEN NOT starts_with(p_name, 'hot') THEN p_size + 2 END)) AS water, sqrt(max(p_size) + 3) AS land FROM (SELECT concat(p_name, ' ', p_size % 7) AS ingredient, p_name, p_retailprice, p_size FROM part WHERE p_name NOT LIKE '%rod') GROUP BY ingredient)"
