"""Queries over neighbourhoods of dish vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.operators import flexibility as X

from . import inputs as I
from .registry import query

RADII = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)
D = """WITH e AS (SELECT vec_id AS idx, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), m AS (SELECT p_partkey AS idx, p_retailprice / 100 AS ghg, CAST(p_size AS DOUBLE) AS health, p_type AS cuisine FROM part),
p AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN a.idx = b.idx THEN 0 ELSE greatest(0, 1 - list_dot_product(a.v, b.v)) END AS d FROM e a, e b)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "embeddings").selectExpr("vec_id AS idx", "embedding AS vector")


def _dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "p_retailprice / 100 AS ghg", "CAST(p_size AS DOUBLE) AS health", "p_type AS cuisine")


GAINS = D + f""", r AS (SELECT unnest({list(RADII)}::DOUBLE[]) AS radius), g AS (SELECT i AS idx, radius, count(*) AS neighbors, (o.ghg - min(n.ghg)) / o.ghg AS ghg, max(n.health) - o.health AS health FROM p JOIN m o ON o.idx = i JOIN m n ON n.idx = j JOIN r ON d <= radius GROUP BY i, radius, o.ghg, o.health)"""


@query("flex_gains", GAINS + " SELECT idx, radius, neighbors, round(ghg, 6) AS ghg, round(health, 6) AS health FROM g")
def flex_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.best_gains(_vectors(spark, sf_dir), _dishes(spark, sf_dir), ["ghg"], ["health"], RADII)
    return g.select("idx", "radius", "neighbors", F.round("ghg", 6).alias("ghg"), F.round("health", 6).alias("health"))


@query("flex_curve", GAINS + " SELECT radius, round(avg(neighbors), 6) AS mean_neighbors, quantile_cont(neighbors, 0.5) AS median_neighbors, round(avg(ghg), 6) AS ghg_mean, round(quantile_cont(ghg, 0.25), 6) AS ghg_p25, round(quantile_cont(ghg, 0.5), 6) AS ghg_median FROM g GROUP BY 1")
def flex_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.best_gains(_vectors(spark, sf_dir), _dishes(spark, sf_dir), ["ghg"], ["health"], RADII)
    return X.curve(g, ["ghg"]).select("radius", F.round("mean_neighbors", 6).alias("mean_neighbors"), "median_neighbors", *[F.round(c, 6).alias(c) for c in ("ghg_mean", "ghg_p25", "ghg_median")])


@query("best_pick", D + ", k AS (SELECT i, j, ghg FROM p JOIN m ON m.idx = j WHERE d <= 0.8) SELECT i AS idx, first(j ORDER BY ghg, j) AS pick FROM k GROUP BY 1")
def best_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.best_pick(_vectors(spark, sf_dir), _dishes(spark, sf_dir), "ghg", 0.8)


SWAPS = "p_partkey AS idx, CAST(1 + p_size AS DOUBLE) AS ghg, CAST(p_partkey % 7 AS DOUBLE) AS health, p_type AS cuisine"


@query(
    "swap_search",
    D.replace("p_retailprice / 100 AS ghg, CAST(p_size AS DOUBLE) AS health", "CAST(1 + p_size AS DOUBLE) AS ghg, CAST(p_partkey % 7 AS DOUBLE) AS health") + ", k AS (SELECT i, j, a.cuisine <> b.cuisine AS o, (a.ghg - b.ghg) / a.ghg + 2 * (b.health - a.health) AS s FROM p JOIN m a ON a.idx = i JOIN m b ON b.idx = j WHERE d <= 0.8 AND i <> j AND b.ghg < a.ghg * 0.9 AND b.health >= a.health) SELECT i AS idx, first(j ORDER BY o, round(s, 9) DESC, j) AS swap FROM k GROUP BY 1",
)
def swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.swap_search(_vectors(spark, sf_dir), I.read(spark, sf_dir, "part").selectExpr(*SWAPS.split(", ")), 0.8)


@query(
    "cobenefit",
    D
    + """, k AS (SELECT i, j, ghg, health FROM p JOIN m ON m.idx = j WHERE d <= 0.8), g AS (SELECT i, first(j ORDER BY ghg, j) AS g, first(j ORDER BY health DESC, j) AS h FROM k GROUP BY 1), w AS (SELECT i, max(CASE WHEN k.ghg < o.ghg AND k.health > o.health THEN 1 ELSE 0 END) AS win FROM k JOIN m o ON o.idx = i GROUP BY 1)
SELECT round(avg(CASE WHEN a.health > o.health THEN 1 ELSE 0 END), 6) AS greenest_healthier, round(avg(CASE WHEN b.ghg < o.ghg THEN 1 ELSE 0 END), 6) AS healthiest_greener, round(avg(win), 6) AS win_win FROM g JOIN m o ON o.idx = i JOIN m a ON a.idx = g.g JOIN m b ON b.idx = g.h JOIN w USING (i)""",
)
def cobenefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.co_benefits(_vectors(spark, sf_dir), _dishes(spark, sf_dir), 0.8)
    return x.select(*[F.round(c, 6).alias(c) for c in ("greenest_healthier", "healthiest_greener", "win_win")])


TOL = (0.0, 5.0, 10.0, 20.0, 100.0)
MACRO = "CAST(p_size % 10 + 1 AS DOUBLE) AS pr, CAST(p_size % 7 + 1 AS DOUBLE) AS fa, CAST(p_size % 13 + 1 AS DOUBLE) AS ca"


@query(
    "flex_macro",
    D
    + f""", x AS (SELECT p_partkey AS idx, {MACRO} FROM part), s AS (SELECT idx, 400 * pr / (4 * pr + 9 * fa + 4 * ca) AS a, 900 * fa / (4 * pr + 9 * fa + 4 * ca) AS b, 400 * ca / (4 * pr + 9 * fa + 4 * ca) AS c FROM x), q AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE (abs(u.a - v.a) + abs(u.b - v.b) + abs(u.c - v.c)) / 2 END AS tv FROM p JOIN s u ON u.idx = i JOIN s v ON v.idx = j WHERE d <= 0.8),
t AS (SELECT unnest({list(TOL)}::DOUBLE[]) AS tolerance), g AS (SELECT i, tolerance, (o.ghg - min(n.ghg)) / o.ghg AS gain FROM q JOIN m o ON o.idx = i JOIN m n ON n.idx = j JOIN t ON tv <= tolerance GROUP BY i, tolerance, o.ghg) SELECT tolerance, round(avg(gain), 6) AS mean_gain FROM g GROUP BY 1""",
)
def flex_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "p_retailprice / 100 AS ghg", *[e + "" for e in MACRO.split(", ")])
    dishes = x.select("idx", "ghg", X.macro_shares(F.col("pr"), F.col("fa"), F.col("ca")).alias("shares"))
    return X.tolerance_sweep(_vectors(spark, sf_dir), dishes, "ghg", TOL, 0.8).withColumn("mean_gain", F.round("mean_gain", 6))
