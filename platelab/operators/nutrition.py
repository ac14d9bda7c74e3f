"""Nutrients of foods and of recipes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.functions import scores as S


def pivot_nutrients(food: DataFrame, amounts: DataFrame, wanted: dict[str, tuple[int, ...]], required: str | None = None, default: float = 0.0) -> DataFrame:
    """One row per food with a column per nutrient, from the first of its ids that the food has.

    Foods without the required nutrient are left out; other nutrients default.
    """
    ids = sorted({i for v in wanted.values() for i in v})
    by = amounts.where(F.col("nutrient_id").isin(ids)).groupBy("fdc_id").agg(*[F.max(F.when(F.col("nutrient_id") == i, F.col("amount"))).alias(f"n{i}") for i in ids])
    first = lambda v: F.coalesce(*[F.col(f"n{i}") for i in v])
    x = food.join(by, "fdc_id", "left").select(*food.columns, *[first(v).alias(n) for n, v in wanted.items()])
    x = x.where(F.col(required).isNotNull()) if required else x
    return x.select(*food.columns, *[F.round(F.coalesce(n, F.lit(default)), 2).alias(n) for n in wanted])


def with_category(food: DataFrame, branded: DataFrame, coded: DataFrame, codes: DataFrame) -> DataFrame:
    """Category of a food under either scheme, empty if it has none."""
    named = coded.join(codes, "category_id", "left").select("fdc_id", F.col("description").alias("c1"))
    return food.join(named, "fdc_id", "left").join(branded.select("fdc_id", F.col("category").alias("c2")), "fdc_id", "left").withColumn("fdc_category", F.coalesce("c1", "c2", F.lit(""))).drop("c1", "c2")


def foods(*tables: tuple[DataFrame, str, str | None]) -> DataFrame:
    """Union of food tables, each under its source name and, if a type is given, with rows of that type only."""
    out = None
    for table, source, kind in tables:
        x = (table if kind is None else table.where(F.col("data_type") == kind)).select("fdc_id", "description").withColumn("source", F.lit(source))
        out = x if out is None else out.unionByName(x)
    return out


def pick_index(reply: Column, n: Column) -> Column:
    """A choice counted from 1: 0 means the first, anything outside means none."""
    i = F.regexp_extract(reply, "(\\d+)", 1).try_cast("int")
    return F.when(i == 0, 1).when((i >= 1) & (i <= n), i)


def matched_food(names: DataFrame, overrides: DataFrame, cache: DataFrame, top: DataFrame) -> DataFrame:
    """Food of each ingredient: an override, else the cached match, else the nearest at low confidence."""
    key = names.withColumn("key", F.lower(F.trim("ingredient")))
    x = key.join(overrides.select("key", F.col("fdc_id").alias("o")), "key", "left").join(cache.select("key", F.col("fdc_id").alias("c"), F.col("confidence").alias("cc")), "key", "left").join(top.select("key", F.col("fdc_id").alias("t")), "key", "left")
    sure = F.when(F.col("o").isNotNull(), "high").when(F.col("c").isNotNull(), F.col("cc")).when(F.col("t").isNotNull(), "low")
    return x.select("ingredient", F.coalesce("o", "c", "t").alias("fdc_id"), sure.alias("confidence"), F.coalesce("o", "c", "t").isNull().alias("unmatched"))


def macros(rows: DataFrame, table: DataFrame, nutrients: tuple[str, ...] = ("energy_kcal", "protein_g", "fat_g", "carb_g"), servings: int = 4) -> DataFrame:
    """Nutrients of a recipe from its rows (recipe_id, ingredient, grams) and contents per 100 g.

    Contributions are rounded before they are summed; a serving is a quarter of the sum before it is rounded. Sums lose
    what the order of addition leaves beyond six digits, so that ties round the same way everywhere.
    """
    t = table.withColumn("key", F.lower(F.trim("ingredient"))).drop("ingredient").dropDuplicates(["key"])
    x = rows.where("grams > 0").withColumn("key", F.lower(F.trim("ingredient"))).join(t, "key", "left")
    known = F.col(nutrients[0]).isNotNull()
    part = {n: F.sum(F.round(F.col(n) * F.col("grams") / 100, 2)) for n in nutrients}
    sums = x.groupBy("recipe_id").agg(F.sum("grams").alias("mass_g"), F.coalesce(F.sum(F.when(known, F.col("grams"))), F.lit(0.0)).alias("known_g"), *[F.round(F.coalesce(p, F.lit(0.0)), 6).alias(f"t_{n}") for n, p in part.items()])
    return sums.select("recipe_id", "mass_g", F.round(F.try_divide("known_g", "mass_g"), 4).alias("match_rate"), *[F.round(f"t_{n}", 1).alias(n) for n in nutrients], *[F.round(F.col(f"t_{n}") / servings, 1).alias(f"{n}_serving") for n in nutrients])


def run_summary(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("recipes"), F.round(F.avg("match_rate"), 4).alias("mean_match_rate"), F.count_if(F.col("match_rate") >= 0.999).alias("full"))


def densities(rows: DataFrame, table: DataFrame, nutrients: tuple[str, ...]) -> DataFrame:
    """Contents in 100 g of each recipe: what is known over the whole mass; fruit share; the food with most mass.

    ``table`` has ingredient, the nutrients, description and category.
    """
    t = table.withColumn("key", F.lower(F.trim("ingredient"))).drop("ingredient").dropDuplicates(["key"]).withColumn("fruit", S.fruit_class(F.col("description"), F.col("category")).isin("fruit", "vegetable", "legume", "nut", "oil")).withColumn("known", F.lit(True))
    x = rows.where("grams > 0").withColumn("key", F.lower(F.trim("ingredient"))).join(t, "key", "left")
    mass = F.sum("grams")
    return x.groupBy("recipe_id").agg(
        mass.alias("mass_g"), *[F.round(F.coalesce(F.sum(F.col(n) * F.col("grams") / 100), F.lit(0.0)) / mass * 100, 3).alias(n) for n in nutrients],
        F.round(100 * F.coalesce(F.sum(F.when(F.col("fruit"), F.col("grams"))), F.lit(0.0)) / mass, 2).alias("fvn_pct"),
        F.max_by(F.when(F.col("known"), F.col("ingredient")), F.when(F.col("known"), F.struct("grams", -F.col("position")))).alias("dominant"),
        F.round(F.coalesce(F.sum(F.when(F.col("known"), F.col("grams"))), F.lit(0.0)) / mass, 4).alias("fdc_match_rate_mass"),
    )


#: Parts of a food's description that say it is cooked (fixed values).
COOKED = ("cook", "boil", "roast", "braise", "grill", "broil", "fried", "baked", "bake,", "steam", "stew", "canned", "simmer", "prepared", "drained", "moist heat", "dry heat")
#: Weight as sold of a unit of cooked weight (fixed values).
COOKED_GRAINS, COOKED_LEGUMES, COOKED_MEAT = 0.45, 0.40, 1 / 0.7


def meal_groups(rows: DataFrame, groups: DataFrame, servings: Column | float = 1.0, least: float = 0.05) -> DataFrame:
    """Grams of each diet group in a serving (recipe_id, group_grams as a map); cooked foods count at the weight that
    they had dry or raw.

    ``groups`` has ingredient, group and the description of the matched food. An ingredient without a matched food is
    classified by its own name and counts at its weight as used. ``servings`` is a number or a column of
    ``rows``; none or 0 counts as 1. Groups under ``least`` grams a serving are left out before rounding.
    """
    g = groups.select(F.lower(F.trim("ingredient")).alias("key"), F.col("group").alias("g"), F.lower(F.coalesce("description", F.lit(""))).alias("about")).dropDuplicates(["key"])
    own = S.diet_group(F.col("ingredient"), F.lit(""))
    x = rows.where("grams > 0").withColumn("key", F.lower(F.trim("ingredient"))).join(g, "key", "left")
    x = x.withColumns({"g": F.coalesce("g", own), "about": F.coalesce("about", F.lit(""))}).where("g <> 'other'")
    cooked = reduce(lambda a, b: a | b, [F.col("about").contains(word) for word in COOKED])
    basis = F.when(cooked & (F.col("g") == "whole_grains"), COOKED_GRAINS).when(cooked & (F.col("g") == "legumes"), COOKED_LEGUMES).when(cooked & F.col("g").isin("red_meat", "processed_meat"), COOKED_MEAT).otherwise(1.0)
    per = F.coalesce(F.nullif(servings if isinstance(servings, Column) else F.lit(float(servings)), F.lit(0.0)), F.lit(1.0))
    sums = x.groupBy("recipe_id", "g").agg((F.sum(F.col("grams") * basis) / F.max(per)).alias("v")).where(F.col("v") >= least)
    return sums.groupBy("recipe_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", F.round("v", 3).alias("v"))))).alias("group_grams"))


def fixed_groups(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """The map as one column per group, 0 where it has none."""
    return rows.select("recipe_id", *[F.coalesce(F.element_at("group_grams", F.lit(g)), F.lit(0.0)).alias(g) for g in groups])


def atwater_gap(rows: DataFrame) -> DataFrame:
    """Median gap between energy and what the macronutrients add up to."""
    made = 4 * F.col("protein_g") + 9 * F.col("fat_g") + 4 * F.col("carb_g")
    return rows.where("energy_kcal > 0").agg(F.round(F.median(F.abs(made - F.col("energy_kcal")) / F.col("energy_kcal")), 6).alias("median_gap"), F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    n = F.count("*")
    x = rows.groupBy(column).agg(n.alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def ingredient_table(rows: DataFrame, matches: DataFrame, nutrients: DataFrame) -> DataFrame:
    """Distinct ingredients with their match and contents, the most frequent first."""
    return rows.join(matches, "ingredient", "left").join(nutrients, "fdc_id", "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(True))).orderBy(F.desc("occurrences"), "ingredient")


def dominant_food(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The known ingredient with most mass of each recipe, the first of equals, its share of the mass, and its class.

    ``table`` has ingredient and class.
    """
    t = table.select(F.lower(F.trim("ingredient")).alias("key"), "class").dropDuplicates(["key"])
    x = rows.where("grams > 0").withColumn("key", F.lower(F.trim("ingredient"))).join(t, "key", "left").withColumn("known", F.col("class").isNotNull())
    best = F.min_by(F.struct("ingredient", "class", "grams"), F.when(F.col("known"), F.struct(-F.col("grams"), F.col("position"), F.col("ingredient"))))
    one = x.groupBy("recipe_id").agg(best.alias("d"), F.sum("grams").alias("mass"))
    return one.where("d.class is not null").select("recipe_id", "d.ingredient", "d.class", F.try_divide("d.grams", "mass").alias("share"))


def manifold(meta: DataFrame, results: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``meta`` with their results, in order; and how many have none."""
    return meta.join(results, key).orderBy(order), meta.join(results, key, "left_anti").agg(F.count("*").alias("missing"))
