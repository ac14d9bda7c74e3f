"""Ingredients of recipes, their impact factors, and the impact of whole recipes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.session import checkpointed


def proportions(ingredients: Column) -> Column:
    """Grams not below 0, shares of the whole in percent, and nameless ones left out (though they count in the whole)."""
    grams = F.transform(ingredients, lambda x: F.greatest(x["grams"], F.lit(0.0)))
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.coalesce(g, F.lit(0.0)))
    rows = F.zip_with(ingredients, grams, lambda x, g: F.struct(x["ingredient"].alias("ingredient"), g.alias("grams"), F.round(F.try_divide(100 * g, total), 2).alias("proportion_pct")))
    return F.filter(rows, lambda x: F.trim(F.coalesce(x["ingredient"], F.lit(""))) != "")


def unique_ingredients(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct ingredients (case and outer spaces aside) as first written, with their occurrences."""
    keyed = rows.withColumn("key", F.lower(F.trim(F.col(name)))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by(F.trim(F.col(name)), F.col(position)).alias("ingredient"), F.count("*").alias("occurrences"))


def factor_table(farm: DataFrame, processing: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Farm and processing factors of each product, the first row of each; processing that is missing adds nothing."""
    first = lambda x: x.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("r = 1").select(key, F.col(value).try_cast("double").alias("v"))
    a, b = first(farm).withColumnRenamed("v", "farm"), first(processing).withColumnRenamed("v", "processing")
    return a.join(b, key, "left").select(key, "farm", "processing", (F.col("farm") + F.coalesce("processing", F.lit(0.0))).alias("total"))


def expand_query(name: Column, table: dict[str, Sequence[str]]) -> Column:
    """Search terms for an ingredient: those of its key, those of its key without parentheses, or none."""
    key = F.lower(F.trim(name))
    bare = F.trim(F.regexp_replace(key, "\\s*\\([^)]*\\)", ""))
    if not table:
        return F.array().cast("array<string>")
    terms = F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(terms, key), F.element_at(terms, bare), F.array().cast("array<string>"))


def top_by_cosine(queries: DataFrame, products: DataFrame, k: dict[str, int], scan: int, excluded: str | None = None, block: int = 8192) -> DataFrame:
    """The nearest products (product_id, name, source, vector) of each query (query_id, vector), so many per source.

    Queries and products are dealt into blocks of bounded size. Each block of queries meets each block of products in
    one row of work, which returns the best ``scan`` of the block for every query; these are merged. The best ``scan``
    per source are taken before the pattern ``excluded`` thins them, as the order matters.
    """
    counts = sorted(tuple(r) for r in products.groupBy("source").count().collect())  # one row per source
    first, at = {}, 0
    for source, n in counts:
        first[source] = (at, parts := max(1, -(-n // block)))
        at += parts
    place = lambda i: F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(v[i])) for s, v in first.items()], F.lit(0))
    own = products.select("source", "product_id", F.col("vector").cast("array<double>").alias("vector"), (place(0) + F.pmod(F.xxhash64("product_id"), place(1).cast("long"))).cast("int").alias("b"))
    known = own.groupBy("b").agg(F.first("source").alias("source"), F.collect_list(F.struct("product_id", "vector")).alias("known"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    groups = max(1, -(-asked.count() // 1024))
    packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    work = packed.select("asked", F.explode(F.sequence(F.lit(0), F.lit(max(0, at - 1)))).alias("b")).join(known, "b").select("source", "asked", "known")

    def rows(x: pa.Array, key: str) -> tuple[np.ndarray, np.ndarray]:
        ids = x.field(key).to_numpy()
        v = x.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        return ids, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, a, b in zip(*batch.columns, strict=True):
                (who, q), (ids, p) = rows(a.values, "query_id"), rows(b.values, "product_id")
                n = min(scan, len(ids))
                for top in range(0, len(who), 128):
                    scores = q[top : top + 128] @ p.T
                    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :n]
                    m = order.size
                    values = [pa.array(np.repeat(who[top : top + 128], n)), pa.array([source.as_py()] * m, pa.string()), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())]
                    yield pa.RecordBatch.from_arrays(values, ["query_id", "source", "product_id", "score"])

    found = work.mapInArrow(nearest, "query_id long, source string, product_id long, score double")
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "product_id")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= scan).join(products.select("product_id", "name"), "product_id")
    if excluded:
        best = best.where(~F.col("name").rlike(excluded))
    limit = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in k.items()], F.lit(0))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "source", "product_id", "name", "score", "rank")


def best_of_queries(found: DataFrame, top: int) -> DataFrame:
    """Candidates of several search terms of one item: the best score of each name, the best ``top`` of these."""
    names = found.groupBy("item", F.lower("name").alias("key")).agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("name"))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    return names.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item", "name", "score", "rank")


def keyword_candidates(items: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """Products whose name holds a word of the item (over two letters), the first few in order of id.

    A word without a space is in a name if it is in one of its words. So distinct words of items meet distinct words of
    products, through a three-letter part that both have, and each word carries only the first few products that it
    leads to: however many items and products share a word, no row is made for each two of them.
    """
    few = lambda rows, key: rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("product_id"))).where(F.col("r") <= most).drop("r")
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    words = words_of(items, "item")
    named = products.select("product_id", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("part"))
    firsts = checkpointed(few(named, "part"))
    parts = firsts.select("part").distinct().withColumn("gram", F.explode(grams(F.col("part"))))
    asked = words.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
    leads = asked.join(parts, "gram").where("contains(part, word)").select("word", "part").distinct()
    by_word = few(leads.join(firsts, "part").select("word", "product_id").distinct(), "word")
    return few(words.join(by_word, "word").select("item", "product_id").distinct(), "item")


def union_candidates(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Candidates (item, name, score) of both kinds, each name once, those by vector first."""
    every = vector.select("item", "name", "score", F.lit(0).alias("kind")).unionByName(keyword.select("item", "name", F.lit(0.0).alias("score"), F.lit(1).alias("kind")))
    w = Window.partitionBy("item", F.lower("name")).orderBy("kind", F.desc("score"), "name")
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def without_judge(candidates: DataFrame) -> DataFrame:
    """Factor of an item where nothing has judged its candidates: median, least and greatest of all."""
    return candidates.groupBy("item").agg(F.median("value").alias("recommended"), F.min("value").alias("least"), F.max("value").alias("most"))


def recommended(candidates: DataFrame, main: str) -> DataFrame:
    """Factor and matched name from the best tier that has any: exact of the main source, any of it, exact, all."""
    a, e = F.col("source") == main, F.col("exact")
    tiers = [a & e, a, e, F.lit(True)]
    median = F.coalesce(*[F.median(F.when(t, F.col("value"))) for t in tiers])
    tier = F.when(tiers[0], 0).when(tiers[1], 1).when(tiers[2], 2).otherwise(3)
    sure = (F.countDistinct("source") >= 2) | (F.count_if(e) >= 2)
    return candidates.groupBy("item").agg(
        median.alias("recommended"), F.min_by("name", F.struct(tier, F.col("position"))).alias("matched_name"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.count("*").alias("n_matches"), F.countDistinct("source").alias("n_sources"), F.when(sure, "high").otherwise("medium").alias("confidence"),
    )


def cross_source(items: DataFrame, products: DataFrame) -> DataFrame:
    """Values of products with a keyword that contains a word of the item (over two letters), or is contained in it
    (item, name, value); each product name once, as its first product has it.

    Either containment is an equality with a part: all parts of the words are listed, which are few as words are short.
    Products of one name are one row before they meet the items.
    """
    products = products.groupBy("name").agg(F.min_by(F.struct("product_id", "value"), "product_id").alias("p")).select("name", "p.*")
    parts = lambda w: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.sequence(F.lit(1), F.length(w) - i + 1), lambda n: F.substring(w, i, n))))))
    a = words_of(items, "item")
    b = words_of(products, "product_id").withColumnRenamed("word", "keyword")
    left, right = a.select("word").distinct(), b.select("keyword").distinct()
    inside = left.select("word", parts(F.col("word")).alias("keyword")).join(right, "keyword").select("word", "keyword").union(right.select("keyword", parts(F.col("keyword")).alias("word")).join(left, "word").select("word", "keyword")).distinct()
    found = a.join(inside, "word").join(b, "keyword").select("item", "product_id").distinct().join(products.select("product_id", "name", "value"), "product_id")
    return found.select("item", "name", "value")


def words_of(rows: DataFrame, key: str) -> DataFrame:
    """Words of over two letters in ``name``, from which everything but letters and spaces is deleted."""
    return rows.select(key, F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("name"), "[^a-z ]", ""), " +"))).alias("word")).where("length(word) > 2")


def widened(rec: Column, least: Column, most: Column, cross: Column) -> Column:
    """Range around a factor: its own, other sources' values within a tenth to ten times, and at least 30 % each way."""
    near = F.filter(F.coalesce(cross, F.array().cast("array<double>")), lambda v: (v >= rec / 10) & (v <= rec * 10))
    low = F.least(least, F.array_min(near), rec * 0.7)
    high = F.greatest(most, F.array_max(near), rec * 1.3)
    return F.struct(F.round(low, 4).alias("least"), F.round(high, 4).alias("most"))


def upsert(cache: DataFrame, new: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Cache rows (key, value, confidence) replaced by new ones of no lower confidence; what they replace is kept."""
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))
    c, n = cache.alias("c"), new.alias("n")
    take = F.col("n.key").isNotNull() & (F.col("c.key").isNull() | (rank(F.col("n.confidence")) >= rank(F.col("c.confidence"))))
    pick = lambda x: F.when(take, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    old = F.col("c.previous_value") if "previous_value" in cache.columns else F.lit(None).cast("double")
    return c.join(n, F.col("c.key") == F.col("n.key"), "full").select(F.coalesce("c.key", "n.key").alias("key"), pick("value"), pick("confidence"), F.when(take, F.col("c.value")).otherwise(old).alias("previous_value"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("confidence").agg(F.count("*").alias("n"), F.count("previous_value").alias("replaced"))


def recipe_rows(recipes: DataFrame) -> DataFrame:
    """One row per ingredient, with its place: recipe_id, position, ingredient, grams."""
    return recipes.select("recipe_id", F.posexplode("ingredients").alias("position", "x")).select("recipe_id", "position", F.col("x.ingredient").alias("ingredient"), F.col("x.grams").alias("grams"))


#: Digits to which values per kg are given (fixed values).
PER_KG_DIGITS = {"ghg": 4, "water": 4, "land": 3, "acidification": 5, "eutrophication": 6}
RATE_DIGITS = 3


def per_kg(value: Column, mass_g: Column, kind: str) -> Column:
    """An impact by kg of mass, null without mass."""
    return F.round(F.try_divide(value, mass_g / 1000), PER_KG_DIGITS[kind])


def recipe_impact(rows: DataFrame, factors: DataFrame, impacts: dict[str, str]) -> DataFrame:
    """Impact of each recipe from its rows (recipe_id, position, ingredient, grams).

    ``factors`` has ingredient, ghg (kg per kg) and the columns that ``impacts`` names. Rows without a name or mass do
    not count, but their mass is part of the recipe; rows without a factor are part of the mass only. Impacts that
    a factor lacks add nothing. Per-kg values are null for a recipe without mass.
    """
    f = factors.select(F.lower(F.trim("ingredient")).alias("key"), F.col("ghg").alias("f_ghg"), *[F.col(c).alias(f"f_{n}") for n, c in impacts.items()]).dropDuplicates(["key"])
    x = rows.withColumn("key", F.lower(F.trim("ingredient"))).join(f, "key", "left")
    valid = (F.col("grams") > 0) & (F.coalesce(F.trim("ingredient"), F.lit("")) != "")
    x = x.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("matched", F.col("valid") & F.col("f_ghg").isNotNull())
    kg = F.when(F.col("matched"), F.col("grams") / 1000)
    sums = x.groupBy("recipe_id").agg(
        F.sum(F.greatest(F.coalesce("grams", F.lit(0.0)), F.lit(0.0))).alias("recipe_mass_g"), F.count_if("valid").alias("n_ingredients"), F.count_if("matched").alias("n_matched"),
        F.sum(F.when(F.col("matched"), F.col("grams"))).alias("matched_g"), F.coalesce(F.sum(kg * F.col("f_ghg") * 1000), F.lit(0.0)).alias("ghg_g"),
        *[F.sum(kg * F.col(f"f_{n}")).alias(n) for n in impacts],
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("valid") & ~F.col("matched"), F.col("ingredient"))))).alias("unmatched"),
    )
    return sums.select(
        "*", F.round(F.try_divide(F.col("n_matched").cast("double"), F.col("n_ingredients")), RATE_DIGITS).alias("match_rate_count"), F.round(F.try_divide(F.coalesce("matched_g", F.lit(0.0)), F.col("recipe_mass_g")), RATE_DIGITS).alias("match_rate_mass"),
        per_kg(F.col("ghg_g") / 1000, F.col("recipe_mass_g"), "ghg").alias("ghg_per_kg"), *[per_kg(F.col(n), F.col("recipe_mass_g"), n).alias(f"{n}_per_kg") for n in impacts],
    )


def breakdown(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Matched ingredients of each recipe, the largest emission first."""
    f = factors.select(F.lower(F.trim("ingredient")).alias("key"), F.col("ghg").alias("f_ghg")).dropDuplicates(["key"])
    x = rows.withColumn("key", F.lower(F.trim("ingredient"))).join(f, "key").where("grams > 0 and f_ghg is not null")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("grams") * F.col("f_ghg")).alias("minus"), "position", "ingredient", "grams")))
    return x.groupBy("recipe_id").agg(F.transform(parts, lambda p: F.struct(p["ingredient"].alias("ingredient"), p["grams"].alias("grams"), (-p["minus"]).alias("ghg_g"))).alias("ingredients"))


def multi_impact(rows: DataFrame, table: DataFrame, impacts: Iterable[str]) -> DataFrame:
    """Impacts of each recipe by mass; what the table (ingredient, impacts) lacks counts as 0 within a match."""
    t = table.withColumn("key", F.lower(F.trim("ingredient"))).drop("ingredient").dropDuplicates(["key"])
    x = rows.where("grams > 0").withColumn("key", F.lower(F.trim("ingredient"))).join(t, "key")
    return x.groupBy("recipe_id").agg(*[F.sum(F.col("grams") / 1000 * F.coalesce(F.col(i), F.lit(0.0))).alias(i) for i in impacts])


def product_pedigree(rows: DataFrame) -> DataFrame:
    """Mark of a recipe from its ingredients' (recipe_id, ingredient, average, ghg_g): the mean of the rounded averages
    by emission, or the plain mean; and the ingredients marked D or F with their share.

    The plain mean is taken of whole hundredths. A mean is rounded at its hundredfold, where a mean that should lie half
    way between two marks but is off by its sums' last bit mostly lies half way again.
    """
    a = F.round("average", 2)
    total = F.sum("ghg_g")
    plain = F.sum(F.round(100 * a).cast("long")) / (100.0 * F.count(a))
    mean = F.when(total > 0, F.try_divide(F.sum(a * F.col("ghg_g")), total)).otherwise(plain)
    w = Window.partitionBy("recipe_id")
    x = rows.withColumn("total", F.sum("ghg_g").over(w)).withColumn("share", F.round(F.try_divide(100 * F.col("ghg_g"), F.col("total")), 1))
    gaps = F.array_sort(F.collect_list(F.when(F.col("average") > 3.5, F.struct("ingredient", "share"))))
    return x.groupBy("recipe_id").agg((F.round(mean * 100) / 100).alias("average"), gaps.alias("gaps"))


#: Impact categories of the factor table and their names here (fixed values).
IMPACT_NAMES = {
    "Changement climatique": "climate_change",
    "Appauvrissement de la couche d'ozone": "ozone_depletion",
    "Rayonnements ionisants": "ionizing_radiation",
    "Formation photochimique d'ozone": "photochemical_ozone_formation",
    "Particules fines": "particulate_matter",
    "Effets toxicologiques sur la santé humaine : substances non-cancérogènes": "human_toxicity_non_carcinogenic",
    "Effets toxicologiques sur la santé humaine : substances cancérogènes": "human_toxicity_carcinogenic",
    "Acidification terrestre et eaux douces": "acidification",
    "Eutrophisation eaux douces": "eutrophication_freshwater",
    "Eutrophisation marine": "eutrophication_marine",
    "Eutrophisation terrestre": "eutrophication_terrestrial",
    "Écotoxicité pour écosystèmes aquatiques d'eau douce": "freshwater_ecotoxicity",
    "Utilisation du sol": "land_use",
    "Épuisement des ressources eau": "water_use",
    "Épuisement des ressources énergétiques": "resource_use_energy",
    "Épuisement des ressources minéraux": "resource_use_minerals",
}


def impact_table(products: DataFrame, product: str, farm_and_processing: str) -> DataFrame:
    """All impacts of each product under the names above: 0 where one is missing, and for climate the value of farm and
    processing where there is one."""
    have = set(products.columns)
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    climate = "climate_change"
    cols = [(F.coalesce(F.col(farm_and_processing).cast("double"), value(old)) if new == climate else value(old)).alias(new) for old, new in IMPACT_NAMES.items()]
    return products.select(F.trim(product).alias("product"), *cols)
