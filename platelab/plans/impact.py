"""Queries over recipes: ingredients, factors, impact, data quality and Monte Carlo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import scores as S
from platelab.operators import impact, montecarlo

from . import inputs as I
from .registry import query

R = f"WITH r AS {I.ROWS_SQL}, f AS {I.FACTORS_SQL}"


@query(
    "proportions",
    f"""WITH x AS (SELECT recipe_id, position, CASE WHEN position = 3 THEN '' ELSE ingredient END AS ingredient, greatest(grams - 10, 0) AS g FROM {I.ROWS_SQL}), s AS (SELECT recipe_id, sum(g) AS t FROM x GROUP BY 1)
SELECT recipe_id, position, ingredient, g AS grams, round(CASE WHEN t <> 0 THEN 100 * g / t END, 2) AS proportion_pct FROM x JOIN s USING (recipe_id) WHERE ingredient <> ''""",
)
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.recipe_rows(spark, sf_dir).withColumn("ingredient", F.when(F.col("position") == 3, "").otherwise(F.col("ingredient")))
    recipes = x.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("position", "ingredient", (F.col("grams") - 10).alias("grams")))).alias("i"))
    shares = recipes.select("recipe_id", F.col("i.position").alias("p"), impact.proportions(F.col("i")).alias("s"), F.filter("i", lambda y: F.trim(y["ingredient"]) != "").alias("k"))
    return shares.select("recipe_id", F.explode(F.arrays_zip(F.col("k.position").alias("position"), F.col("s").alias("s"))).alias("z")).select("recipe_id", "z.position", "z.s.ingredient", "z.s.grams", "z.s.proportion_pct")


@query("unique_ingredients", R + " SELECT lower(ingredient) AS key, count(*) AS occurrences FROM r GROUP BY 1")
def unique_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.recipe_rows(spark, sf_dir).withColumn("at", F.col("recipe_id") * 100 + F.col("position"))
    return impact.unique_ingredients(x, "ingredient", "at").select("key", "occurrences")


@query(
    "factor_table",
    "WITH a AS (SELECT p_name, first(p_retailprice ORDER BY p_partkey) AS farm FROM part GROUP BY 1), b AS (SELECT p_name, first(p_size ORDER BY p_partkey)::DOUBLE AS processing FROM part WHERE p_type <> 'PROMO' AND p_name LIKE 'hot%' GROUP BY 1) SELECT p_name, farm, processing, farm + coalesce(processing, 0) AS total FROM a LEFT JOIN b USING (p_name)",
)
def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    return impact.factor_table(p.selectExpr("p_name", "CAST(p_retailprice AS STRING) AS value", "p_partkey"), p.where("p_type <> 'PROMO' AND p_name LIKE 'hot%'").selectExpr("p_name", "CAST(p_size AS STRING) AS value", "p_partkey"), "p_name", "value", "p_partkey")


IMPACTS = {"water": "water", "land": "land"}


@query(
    "recipe_impact",
    R
    + """, x AS (SELECT r.*, f.ghg AS fg, f.water AS fw, f.land AS fl, f.ghg IS NOT NULL AND grams > 0 AS m FROM r LEFT JOIN f ON lower(r.ingredient) = lower(f.ingredient)),
s AS (SELECT recipe_id, sum(grams) AS mass, count(*) AS n, count(*) FILTER (WHERE m) AS nm, sum(CASE WHEN m THEN grams END) AS mg, coalesce(sum(CASE WHEN m THEN grams / 1000 * fg * 1000 END), 0) AS ghg, sum(CASE WHEN m THEN grams / 1000 * fw END) AS water, sum(CASE WHEN m THEN grams / 1000 * fl END) AS land FROM x GROUP BY 1)
SELECT recipe_id, mass AS recipe_mass_g, n AS n_ingredients, nm AS n_matched, round(ghg, 4) AS ghg_g, round(nm / n, 3) AS match_rate_count, round(coalesce(mg, 0) / mass, 3) AS match_rate_mass, round(ghg / 1000 / (mass / 1000), 4) AS ghg_per_kg, round(water / (mass / 1000), 4) AS water_per_kg, round(land / (mass / 1000), 3) AS land_per_kg FROM s""",
)
def recipe_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = impact.recipe_impact(I.recipe_rows(spark, sf_dir), I.factors(spark, sf_dir), IMPACTS)
    return x.select("recipe_id", "recipe_mass_g", "n_ingredients", "n_matched", F.round("ghg_g", 4).alias("ghg_g"), "match_rate_count", "match_rate_mass", "ghg_per_kg", "water_per_kg", "land_per_kg")


@query("multi_impact", R + " SELECT recipe_id, round(sum(grams / 1000 * coalesce(ghg, 0)), 6) AS ghg, round(sum(grams / 1000 * coalesce(water, 0)), 6) AS water, round(sum(grams / 1000 * coalesce(land, 0)), 6) AS land FROM r JOIN f USING (ingredient) GROUP BY 1")
def multi_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = impact.multi_impact(I.recipe_rows(spark, sf_dir), I.factors(spark, sf_dir), ["ghg", "water", "land"])
    return x.select("recipe_id", *[F.round(c, 6).alias(c) for c in ("ghg", "water", "land")])


@query("impact_breakdown", R + " SELECT recipe_id, count(*) AS n, round(max(grams * ghg), 6) AS largest FROM r JOIN f USING (ingredient) GROUP BY 1")
def impact_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = impact.breakdown(I.recipe_rows(spark, sf_dir), I.factors(spark, sf_dir))
    return x.select("recipe_id", F.size("ingredients").cast("long").alias("n"), F.round(F.get("ingredients", F.lit(0))["ghg_g"], 6).alias("largest"))


CAND = "(SELECT p_name AS item, p_type AS source, p_retailprice AS value, p_size % 4 = 0 AS exact, concat(p_name, ' ', p_brand) AS name, p_partkey AS position FROM part)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "part").selectExpr("p_name AS item", "p_type AS source", "p_retailprice AS value", "p_size % 4 = 0 AS exact", "concat(p_name, ' ', p_brand) AS name", "p_partkey AS position")


@query(
    "tiered_recommend",
    f"""WITH c AS {CAND}, t AS (SELECT *, CASE WHEN source = 'PROMO' AND exact THEN 0 WHEN source = 'PROMO' THEN 1 WHEN exact THEN 2 ELSE 3 END AS tier FROM c)
SELECT item, round(coalesce(median(value) FILTER (WHERE tier = 0), median(value) FILTER (WHERE tier <= 1), median(value) FILTER (WHERE exact), median(value)), 6) AS recommended, first(name ORDER BY tier, position) AS matched_name, min(value) AS least, max(value) AS most, count(*) AS n_matches, count(DISTINCT source) AS n_sources, CASE WHEN count(DISTINCT source) >= 2 OR count(*) FILTER (WHERE exact) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM t GROUP BY item""",
)
def tiered_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.recommended(_candidates(spark, sf_dir), "PROMO").withColumn("recommended", F.round("recommended", 6))


@query("unjudged_factors", f"SELECT item, round(median(value), 6) AS recommended, min(value) AS least, max(value) AS most FROM {CAND} GROUP BY item")
def unjudged_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.without_judge(_candidates(spark, sf_dir)).withColumn("recommended", F.round("recommended", 6))


@query(
    "widen_range",
    f"""WITH c AS (SELECT item, median(value) AS rec, min(value) AS least, max(value) AS most FROM {CAND} GROUP BY item), x AS (SELECT item, v FROM c, (SELECT unnest([1.0, 95.0, 800.0, 2000.0, 9000.0, 99999.0]) AS v)),
n AS (SELECT c.item, min(v) AS lo, max(v) AS hi FROM c JOIN x ON c.item = x.item AND v BETWEEN rec / 10 AND rec * 10 GROUP BY 1)
SELECT item, round(least(c.least, lo, rec * 0.7), 4) AS least, round(greatest(c.most, hi, rec * 1.3), 4) AS most FROM c LEFT JOIN n USING (item)""",
)
def widen_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _candidates(spark, sf_dir).groupBy("item").agg(F.median("value").alias("rec"), F.min("value").alias("least"), F.max("value").alias("most"))
    cross = F.array(*[F.lit(v) for v in (1.0, 95.0, 800.0, 2000.0, 9000.0, 99999.0)])
    return x.select("item", impact.widened(F.col("rec"), F.col("least"), F.col("most"), cross).alias("w")).select("item", "w.*")


@query(
    "cache_upsert",
    """WITH o AS (SELECT p_partkey AS key, p_retailprice AS value, CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS c FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS key, p_size::DOUBLE AS value, CASE p_partkey % 5 WHEN 0 THEN 'high' ELSE 'medium' END AS c FROM part WHERE p_partkey % 3 = 0),
j AS (SELECT coalesce(o.key, n.key) AS key, o.value AS ov, n.value AS nv, o.c AS oc, n.c AS nc, n.key IS NOT NULL AND (o.key IS NULL OR (CASE n.c WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) >= (CASE o.c WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)) AS take FROM o FULL JOIN n ON o.key = n.key)
SELECT key, CASE WHEN take THEN nv ELSE ov END AS value, CASE WHEN take THEN nc ELSE oc END AS confidence, CASE WHEN take THEN ov END AS previous_value FROM j""",
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS key", "p_retailprice AS value", "CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence")
    new = p.where("p_partkey % 3 = 0").selectExpr("p_partkey AS key", "CAST(p_size AS DOUBLE) AS value", "CASE p_partkey % 5 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence")
    return impact.upsert(old, new, {"low": 1, "medium": 2, "high": 3})


SOURCES = (("ECON|STAN", "A"), ("PROMO|STAN", "B"), ("LARGE|PROMO|STAN", "C"))
MARKS = {"A": 1, "B": 2, "C": 2}, {"A": 1, "B": 2, "C": 3}, {"A": 3, "B": 2}


@query(
    "pedigree",
    """WITH x AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(p_type, 'ECON|STAN') THEN 'A' END, CASE WHEN regexp_matches(p_type, 'PROMO|STAN') THEN 'B' END, CASE WHEN regexp_matches(p_type, 'LARGE|PROMO|STAN') THEN 'C' END], lambda t: t IS NOT NULL) AS s,
 CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf, CASE WHEN p_size % 2 = 0 THEN 'LLM guess' ELSE 'table' END AS meth, p_size % 5 AS n FROM part),
y AS (SELECT *, CASE len(s) WHEN 0 THEN CASE WHEN meth = 'LLM guess' THEN 4 ELSE 5 END WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS a, CASE WHEN len(s) = 0 THEN CASE WHEN meth = 'LLM guess' THEN 5 ELSE 4 END ELSE list_min(list_transform(s, lambda t: CASE t WHEN 'A' THEN 1 ELSE 2 END)) END AS b,
 CASE WHEN len(s) = 0 THEN CASE WHEN meth = 'LLM guess' THEN 4 ELSE 5 END ELSE list_min(list_transform(s, lambda t: CASE t WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END)) END AS c, CASE WHEN len(s) = 0 THEN 5 ELSE list_min(list_transform(s, lambda t: CASE t WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 4 END)) END AS d,
 CASE WHEN conf = 'high' AND n >= 3 THEN 1 WHEN conf = 'high' THEN 2 WHEN conf = 'medium' THEN 3 WHEN meth = 'LLM guess' THEN 4 ELSE 5 END AS e FROM x)
SELECT p_partkey, a::INT AS reliability, b::INT AS completeness, c::INT AS temporal, d::INT AS geographic, e::INT AS technological, (a + b + c + d + e) / 5 AS average, CASE WHEN (a + b + c + d + e) / 5 <= 1.5 THEN 'A' WHEN (a + b + c + d + e) / 5 <= 2.5 THEN 'B' WHEN (a + b + c + d + e) / 5 <= 3.5 THEN 'C' WHEN (a + b + c + d + e) / 5 <= 4.5 THEN 'D' ELSE 'F' END AS grade FROM y""",
)
def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf", "CASE WHEN p_size % 2 = 0 THEN 'LLM guess' ELSE 'table' END AS meth", "p_size % 5 AS n")
    return x.select("p_partkey", S.pedigree(S.sources_named(F.col("p_type"), SOURCES), F.col("conf"), F.col("meth"), F.col("n"), *MARKS).alias("q")).select("p_partkey", "q.*")


@query(
    "product_pedigree",
    R + """, x AS (SELECT recipe_id, r.ingredient, position, 1 + (position % 5) * 0.9 AS average, coalesce(grams * ghg, 0) AS g FROM r LEFT JOIN f USING (ingredient))
SELECT recipe_id, round(CASE WHEN sum(g) > 0 THEN sum(round(average, 2) * g) / sum(g) ELSE avg(round(average, 2)) END, 2) AS average, count(*) FILTER (WHERE average > 3.5) AS n_gaps FROM x GROUP BY 1""",
)
def product_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.recipe_rows(spark, sf_dir).join(I.factors(spark, sf_dir), "ingredient", "left").withColumn("average", 1 + (F.col("position") % 5) * 0.9).withColumn("ghg_g", F.coalesce(F.col("grams") * F.col("ghg"), F.lit(0.0)))
    return impact.product_pedigree(x).select("recipe_id", "average", F.size("gaps").cast("long").alias("n_gaps"))


@query(
    "vector_topk",
    """WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT vec_id AS product_id, CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS source, concat('product ', label) AS name, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
s AS (SELECT query_id, source, product_id, name, list_cosine_similarity(q.v, p.v) AS score FROM q, p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, product_id) AS r FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, product_id) AS rank FROM r WHERE r <= 40 AND name NOT LIKE '%3%')
SELECT query_id, source, product_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= CASE source WHEN 'A' THEN 20 ELSE 10 END""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.read(spark, sf_dir, "embeddings")
    p = e.selectExpr("vec_id AS product_id", "CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS source", "concat('product ', label) AS name", "embedding AS vector")
    q = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    return impact.top_by_cosine(q, p, {"A": 20, "B": 10}, 40, "3").select("query_id", "source", "product_id", F.round("score", 6).alias("score"), "rank")


def _simulated(spark: SparkSession, sf_dir: str, **what) -> DataFrame:
    x = I.recipe_rows(spark, sf_dir).join(I.factors(spark, sf_dir), "ingredient")
    low = F.col("ghg") / 2
    x = x.select("recipe_id", "position", "ingredient", "grams", low.alias("least"), F.col("ghg").alias("mode"), F.when(F.col("position") == 2, low).otherwise(F.col("ghg") * 2).alias("most"))
    return montecarlo.simulated(x, **what)


#: Ten thousand draws of every recipe are too many for SQL; tests hold both queries against the draws themselves.
@query("monte_carlo_summary")
def monte_carlo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, top=0).select("recipe_id", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "p5", "p50", "p95")])


@query("variance_drivers")
def variance_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _simulated(spark, sf_dir, percentiles=False).select("recipe_id", F.posexplode("drivers").alias("at", "d"))
    return x.select("recipe_id", (F.col("at") + 1).alias("rank"), "d.ingredient", F.round("d.share", 4).alias("share"))


@query(
    "keyword_candidates",
    "WITH i AS (SELECT DISTINCT p_name AS item FROM part), w AS (SELECT item, unnest(string_split(item, ' ')) AS word FROM i), p AS (SELECT p_partkey AS product_id, lower(concat(p_type, ' ', p_name)) AS product FROM part), h AS (SELECT DISTINCT item, product_id FROM w JOIN p ON contains(product, word) WHERE length(word) > 2) SELECT item, product_id FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY product_id) AS r FROM h) WHERE r <= 5",
)
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    items = p.selectExpr("p_name AS item", "p_name AS name").distinct()
    return impact.keyword_candidates(items, p.selectExpr("p_partkey AS product_id", "concat(p_type, ' ', p_name) AS name"))


@query(
    "multi_query_topk",
    "WITH f AS (SELECT p_brand AS item, p_name AS name, (p_partkey * 7919 % 10007)::DOUBLE AS score FROM part), n AS (SELECT item, lower(name) AS key, max(score) AS score FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, key) AS rank FROM n) SELECT item, key AS name, score, rank::INT AS rank FROM r WHERE rank <= 4",
)
def multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.read(spark, sf_dir, "part").selectExpr("p_brand AS item", "p_name AS name", "CAST(p_partkey * 7919 % 10007 AS DOUBLE) AS score")
    return impact.best_of_queries(f, 4)


CROSS_ITEMS, CROSS_PRODUCTS = "p_name AS item, concat(p_name, ' (2%)') AS name", "p_partkey AS product_id, concat(substr(p_name, 2, 4 + p_size % 3), ' ', p_type) AS name, CAST(p_size AS DOUBLE) AS value"


@query(
    "cross_source",
    f"""WITH i AS (SELECT DISTINCT {CROSS_ITEMS} FROM part), p AS (SELECT {CROSS_PRODUCTS} FROM part), w AS (SELECT item, unnest(string_split(regexp_replace(lower(name), '[^a-z ]', '', 'g'), ' ')) AS w FROM i), k AS (SELECT product_id, name, value, unnest(string_split(regexp_replace(lower(name), '[^a-z ]', '', 'g'), ' ')) AS k FROM p)
SELECT item, name, arg_min(value, product_id) AS value FROM w JOIN k ON length(w) > 2 AND length(k) > 2 AND (contains(w, k) OR contains(k, w)) GROUP BY item, name""",
)
def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    items, products = p.selectExpr(*CROSS_ITEMS.split(", ", 1)).distinct(), p.selectExpr("p_partkey AS product_id", "concat(substr(p_name, 2, 4 + p_size % 3), ' ', p_type) AS name", "CAST(p_size AS DOUBLE) AS value")
    return impact.cross_source(items, products)
