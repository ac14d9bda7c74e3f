"""Queries over nutrients, profiles and diet groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import scores as S
from platelab.operators import nutrition

from . import inputs as I
from .registry import query

#: Contents per 100 g made from parts, in both engines.
FOOD = "p_partkey, CAST(p_size * 17 % 900 AS DOUBLE) AS energy_kcal, CAST(p_size * 7 % 50 AS DOUBLE) AS sugars_g, CAST(p_size * 3 % 13 AS DOUBLE) AS sat_g, CAST(p_size * 41 % 1000 AS DOUBLE) AS sodium_mg, CAST(p_size % 10 AS DOUBLE) AS protein_g, CAST(p_size % 6 AS DOUBLE) AS fibre_g, CAST(p_partkey % 101 AS DOUBLE) AS fruit, CAST(p_size * 5 % 40 AS DOUBLE) AS fat_g, CASE p_partkey % 5 WHEN 0 THEN 'beverage' WHEN 1 THEN 'cheese' WHEN 2 THEN 'fat' ELSE 'general' END AS kind, p_partkey % 20 = 0 AS water"


def _points(x: str, grid: list) -> str:
    return "(" + " + ".join(f"({x} > {t})::INT" for t in grid) + ")"


NUTRI = f"""WITH f AS (SELECT {FOOD} FROM part),
p AS (SELECT *, CASE WHEN kind = 'beverage' THEN {_points('energy_kcal * 4.184', S.ENERGY_KJ_BEVERAGE)} ELSE {_points('energy_kcal * 4.184', S.ENERGY_KJ)} END + CASE WHEN kind = 'beverage' THEN {_points('sugars_g', S.SUGAR_G_BEVERAGE)} ELSE {_points('sugars_g', S.SUGAR_G)} END
 + CASE WHEN kind = 'fat' THEN {_points('(CASE WHEN fat_g > 0 THEN sat_g / fat_g * 100 ELSE 0 END)', S.SATURATED_SHARE)} ELSE {_points('sat_g', S.SATURATED_G)} END + {_points('sodium_mg', S.SODIUM_MG)} AS negative_points,
 list_extract(CASE WHEN kind = 'beverage' THEN [0, 2, 4, 10] ELSE [0, 1, 2, 5] END, 1 + {_points('fruit', S.FRUIT_SHARE)}) AS fp, {_points('fibre_g', S.FIBRE_G)} AS bp, {_points('protein_g', S.PROTEIN_G)} AS pp FROM f),
s AS (SELECT *, negative_points - (fp + bp + CASE WHEN negative_points >= 11 AND fp < 5 AND kind <> 'cheese' THEN 0 ELSE pp END) AS score FROM p)
SELECT p_partkey, negative_points::INT AS negative_points, score::INT AS score, CASE WHEN kind = 'beverage' THEN CASE WHEN water THEN 'A' WHEN score <= 1 THEN 'B' WHEN score <= 5 THEN 'C' WHEN score <= 9 THEN 'D' ELSE 'E' END ELSE CASE WHEN score <= -1 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 10 THEN 'C' WHEN score <= 18 THEN 'D' ELSE 'E' END END AS grade,
 round(greatest(0, least(1, (score + 15) / 55)) * 100, 2) AS score_0to100 FROM s"""


@query("nutriscore", NUTRI)
def nutriscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr(*_split(FOOD))
    c = F.col
    profile = S.nutri_score(c("energy_kcal"), c("sugars_g"), c("sat_g"), c("sodium_mg"), c("protein_g"), c("fibre_g"), c("fruit"), c("fat_g"), c("kind"), c("water"))
    return x.select("p_partkey", profile.alias("s")).select("p_partkey", "s.negative_points", "s.score", "s.grade", "s.score_0to100")


def _split(expressions: str) -> list[str]:
    """Expressions between the commas that are outside parentheses."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(expressions):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(expressions[start:i])
            start = i + 1
    return [*out, expressions[start:]]


AMOUNTS = "(SELECT l_orderkey AS fdc_id, CASE l_linenumber WHEN 1 THEN 1008 WHEN 2 THEN 2047 WHEN 3 THEN 1003 WHEN 4 THEN 1004 ELSE 1005 END AS nutrient_id, l_quantity AS amount FROM lineitem)"


@query(
    "nutrient_pivot",
    f"""WITH a AS {AMOUNTS}, p AS (SELECT fdc_id, max(amount) FILTER (WHERE nutrient_id = 2047) AS e1, max(amount) FILTER (WHERE nutrient_id = 1008) AS e2, max(amount) FILTER (WHERE nutrient_id = 1003) AS p, max(amount) FILTER (WHERE nutrient_id = 1004) AS f FROM a GROUP BY 1)
SELECT o_orderkey AS fdc_id, round(coalesce(e1, e2), 2) AS energy_kcal, round(coalesce(p, 0), 2) AS protein_g, round(coalesce(f, 0), 2) AS fat_g FROM orders JOIN p ON o_orderkey = fdc_id WHERE coalesce(e1, e2) IS NOT NULL""",
)
def nutrient_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = I.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS fdc_id", "CASE l_linenumber WHEN 1 THEN 1008 WHEN 2 THEN 2047 WHEN 3 THEN 1003 WHEN 4 THEN 1004 ELSE 1005 END AS nutrient_id", "l_quantity AS amount")
    food = I.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS fdc_id")
    return nutrition.pivot_nutrients(food, amounts, {"energy_kcal": (2047, 1008), "protein_g": (1003,), "fat_g": (1004,)}, required="energy_kcal")


TABLE = "(SELECT concat(p_name, ' ', p_size % 7) AS ingredient, sqrt(max(p_size) * 700 + 3) AS energy_kcal, sqrt(max(p_size) + 2) AS protein_g, sqrt(max(p_size) + 5) AS fat_g, sqrt(max(p_size) + 7) AS carb_g FROM part WHERE p_name NOT LIKE '%rod' GROUP BY 1)"


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.max("p_size")
    x = I.read(spark, sf_dir, "part").where("p_name NOT LIKE '%rod'").groupBy(F.concat("p_name", F.lit(" "), F.col("p_size") % 7).alias("ingredient"))
    return x.agg(F.sqrt(m * 700 + 3).alias("energy_kcal"), F.sqrt(m + 2).alias("protein_g"), F.sqrt(m + 5).alias("fat_g"), F.sqrt(m + 7).alias("carb_g"))


@query(
    "macro_aggregate",
    f"""WITH r AS {I.ROWS_SQL}, t AS {TABLE}, x AS (SELECT recipe_id, sum(grams) AS mass_g, coalesce(sum(CASE WHEN energy_kcal IS NOT NULL THEN grams END), 0) AS known, {", ".join(f"coalesce(sum(round(({n} * grams / 100)::DOUBLE, 2)), 0) AS {n}" for n in ("energy_kcal", "protein_g", "fat_g", "carb_g"))} FROM r LEFT JOIN t USING (ingredient) GROUP BY 1)
SELECT recipe_id, mass_g, round(known / mass_g, 4) AS match_rate, round(round(energy_kcal, 6), 1) AS energy_kcal, round(round(protein_g, 6), 1) AS protein_g FROM x""",
)
def macro_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nutrition.macros(I.recipe_rows(spark, sf_dir), _table(spark, sf_dir)).select("recipe_id", "mass_g", "match_rate", "energy_kcal", "protein_g")


@query(
    "macro_summary",
    f"""WITH r AS {I.ROWS_SQL}, t AS {TABLE}, x AS (SELECT recipe_id, round(coalesce(sum(CASE WHEN energy_kcal IS NOT NULL THEN grams END), 0) / sum(grams), 4) AS m FROM r LEFT JOIN t USING (ingredient) GROUP BY 1) SELECT count(*) AS recipes, round(avg(m), 4) AS mean_match_rate, count(*) FILTER (WHERE m >= 0.999) AS "full" FROM x""",
)
def macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nutrition.run_summary(nutrition.macros(I.recipe_rows(spark, sf_dir), _table(spark, sf_dir)))


NAMES = "CASE p_partkey % 12 WHEN 0 THEN 'Beans, black, cooked' WHEN 1 THEN 'Oil, olive oil' WHEN 2 THEN 'Rice, brown' WHEN 3 THEN 'Bacon bits' WHEN 4 THEN 'Beef steak' WHEN 5 THEN 'Chicken liver' WHEN 6 THEN 'Tofu burger, vegan' WHEN 7 THEN 'Tomato soup' WHEN 8 THEN 'Potato, boiled' WHEN 9 THEN 'Almonds, dry' WHEN 10 THEN 'Apple pie' ELSE 'Spices, pepper' END"
CLASSES = {0: ("legume", "legumes"), 1: ("oil", "other"), 2: ("none", "whole_grains"), 3: ("none", "processed_meat"), 4: ("none", "red_meat"), 5: ("none", "other"), 6: ("legume", "legumes"), 7: ("vegetable", "vegetables"), 8: ("none", "other"), 9: ("nut", "nuts_seeds"), 10: ("fruit", "fruits"), 11: ("none", "other")}


@query("food_classes", "SELECT p_partkey, " + ", ".join("CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{v[i]}'" for k, v in CLASSES.items()) + f" END AS {n}" for i, n in enumerate(("fruit_class", "diet_group"))) + " FROM part")
def food_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAMES} AS d")
    return x.select("p_partkey", S.fruit_class(F.col("d"), F.lit("")).alias("fruit_class"), S.diet_group(F.col("d"), F.lit("")).alias("diet_group"))


@query("class_histogram", "WITH x AS (SELECT CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in CLASSES.items()) + " END AS diet_group FROM part) SELECT diet_group, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM x GROUP BY 1")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nutrition.histogram(food_classes(spark, sf_dir), "diet_group")


GROUPS = "CASE WHEN ingredient LIKE '%gear%' THEN 'legumes' WHEN ingredient LIKE '%bolt%' THEN 'red_meat' WHEN ingredient LIKE '%ring%' THEN 'whole_grains' ELSE 'other' END"
#: Ingredients without a matched food, which their names tell.
UNMATCHED = "CASE WHEN ingredient LIKE '%widget%' THEN concat('Ground Beef, cooked ', ingredient) WHEN ingredient LIKE '%anvil%' THEN concat('rice, brown ', ingredient) ELSE ingredient END"
ABOUT = "concat(ingredient, CASE right(ingredient, 1) WHEN '1' THEN ', cooked' WHEN '2' THEN ', Canned, drained' WHEN '3' THEN ', stewed meat' WHEN '4' THEN ', dry heat' ELSE ', raw' END)"


@query(
    "meal_groups",
    f"""WITH r AS {I.ROWS_SQL}, d AS (SELECT *, CASE WHEN ingredient LIKE '%widget%' THEN 'red_meat' WHEN ingredient LIKE '%anvil%' THEN 'whole_grains' ELSE {GROUPS} END AS g, lower({ABOUT}) AS about, CASE WHEN recipe_id % 3 = 0 THEN 1 ELSE recipe_id % 3 END AS servings FROM r),
x AS (SELECT recipe_id, g, servings, grams * CASE WHEN ingredient LIKE '%widget%' OR ingredient LIKE '%anvil%' THEN 1 WHEN NOT regexp_matches(about, 'cook|boil|roast|brais|grill|broil|fried|baked|steam|stew|canned|simmer|prepared|drained|moist heat|dry heat') THEN 1 WHEN g = 'whole_grains' THEN 0.45 WHEN g = 'legumes' THEN 0.4 WHEN g = 'red_meat' THEN 1 / 0.7 ELSE 1 END AS v FROM d WHERE g <> 'other'),
s AS (SELECT recipe_id, g, (sum(v) / any_value(servings))::DOUBLE AS v FROM x GROUP BY ALL HAVING sum(v) / any_value(servings) >= 0.05)
SELECT recipe_id, round(coalesce(max(v) FILTER (WHERE g = 'legumes'), 0), 3) AS legumes, round(coalesce(max(v) FILTER (WHERE g = 'red_meat'), 0), 3) AS red_meat, round(coalesce(max(v) FILTER (WHERE g = 'whole_grains'), 0), 3) AS whole_grains FROM s GROUP BY 1""",
)
def meal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.recipe_rows(spark, sf_dir).withColumn("ingredient", F.expr(UNMATCHED))
    known = "ingredient NOT LIKE 'Ground%' AND ingredient NOT LIKE 'rice,%'"
    groups = rows.where(known).select("ingredient").distinct().withColumn("group", F.expr(GROUPS)).withColumn("description", F.expr(ABOUT))
    return nutrition.fixed_groups(nutrition.meal_groups(rows, groups, (F.col("recipe_id") % 3).cast("double")), ("legumes", "red_meat", "whole_grains"))


@query(
    "densities",
    f"""WITH r AS {I.ROWS_SQL}, t AS {TABLE}, x AS (SELECT * FROM r LEFT JOIN t USING (ingredient))
SELECT recipe_id, sum(grams) AS mass_g, round(coalesce(sum(energy_kcal * grams / 100), 0) / sum(grams) * 100, 3) AS energy_kcal, round(100 * coalesce(sum(CASE WHEN ingredient LIKE '%ring%' AND energy_kcal IS NOT NULL THEN grams END), 0) / sum(grams), 2) AS fvn_pct, round(coalesce(sum(CASE WHEN energy_kcal IS NOT NULL THEN grams END), 0) / sum(grams), 4) AS fdc_match_rate_mass FROM x GROUP BY 1""",
)
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir).withColumn("description", F.when(F.col("ingredient").contains("ring"), "apple").otherwise("salt")).withColumn("category", F.lit(""))
    x = nutrition.densities(I.recipe_rows(spark, sf_dir), t, ("energy_kcal",))
    return x.select("recipe_id", "mass_g", "energy_kcal", "fvn_pct", "fdc_match_rate_mass")


@query("atwater_gap", f"WITH t AS {TABLE} SELECT round(median(abs(4 * protein_g + 9 * fat_g + 4 * carb_g - energy_kcal) / energy_kcal), 6) AS median_gap, count(*) AS n FROM t WHERE energy_kcal > 0")
def atwater_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nutrition.atwater_gap(_table(spark, sf_dir))


@query(
    "matched_food",
    "SELECT p_name AS ingredient, CASE WHEN p_name LIKE 'hot%' THEN 1 WHEN p_name LIKE '%ring' THEN 2 WHEN p_name LIKE 'c%' THEN 3 END::BIGINT AS fdc_id, CASE WHEN p_name LIKE 'hot%' THEN 'high' WHEN p_name LIKE '%ring' THEN 'medium' WHEN p_name LIKE 'c%' THEN 'low' END AS confidence, NOT (p_name LIKE 'hot%' OR p_name LIKE '%ring' OR p_name LIKE 'c%') AS unmatched FROM (SELECT DISTINCT p_name FROM part)",
)
def matched_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = I.read(spark, sf_dir, "part").selectExpr("p_name AS ingredient").distinct()
    key = names.select(F.col("ingredient").alias("key"))
    one = lambda where, i: key.where(where).withColumn("fdc_id", F.lit(i).cast("long"))
    return nutrition.matched_food(names, one("key LIKE 'hot%'", 1), one("key LIKE '%ring'", 2).withColumn("confidence", F.lit("medium")), one("key LIKE 'c%'", 3))
