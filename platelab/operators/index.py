"""The canonical index: menu rows joined with restaurants and the alias table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.functions import text as T

STAGES = ("excluded_restaurant", "excluded_category", "no_match", "matched")


def staged(menus: DataFrame, restaurants: DataFrame, excluded_tags: Iterable[str], excluded_categories: DataFrame, aliases: DataFrame, synonyms: Mapping[str, str], unescape: bool = True) -> DataFrame:
    """Menu rows (restaurant_id, category, name, price_usd) with the stage at which they leave, and their canonical name.

    The first stage that applies counts. Restaurants and aliases are joined by key: Spark broadcasts them while they
    are small and shuffles them otherwise.
    """
    kept = restaurants.where(~F.coalesce(F.arrays_overlap(T.tags(F.col("category")), T.literal_array(sorted(excluded_tags))), F.lit(False)))
    kept = kept.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), F.col("category").alias("restaurant_category"), *[c for c in restaurants.columns if c not in ("id", "name", "category")], F.lit(True).alias("has_restaurant"))
    gone = excluded_categories.toDF("excluded_category").where("excluded_category is not null").distinct()
    canonical = aliases.groupBy("alias_name").agg(F.max("canonical_name").alias("canonical_dish"))
    x = menus.join(kept, "restaurant_id", "left").join(gone, menus["category"] == gone["excluded_category"], "left")
    x = x.withColumn("key", T.lookup_key(F.col("name"), F.col("category"), synonyms, unescape)).join(canonical, F.col("key") == F.col("alias_name"), "left").drop("alias_name")
    stage = F.when(F.col("has_restaurant").isNull(), STAGES[0]).when(F.col("excluded_category").isNotNull(), STAGES[1]).when(F.col("canonical_dish").isNull(), STAGES[2]).otherwise(STAGES[3])
    return x.withColumn("stage", stage).drop("has_restaurant", "excluded_category")


def build_index(menus: DataFrame, restaurants: DataFrame, excluded_tags: Iterable[str], excluded_categories: DataFrame, aliases: DataFrame, synonyms: Mapping[str, str], unescape: bool = True) -> DataFrame:
    """One row per menu row that is matched; everything that is excluded is left out before names are normalised."""
    tags = T.tags(F.col("category"))
    kept = restaurants.where(~F.coalesce(F.arrays_overlap(tags, T.literal_array(sorted(excluded_tags))), F.lit(False)))
    kept = kept.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), F.col("category").alias("restaurant_category"), *[c for c in restaurants.columns if c not in ("id", "name", "category")])
    gone = excluded_categories.toDF("excluded_category").where("excluded_category is not null").distinct()
    x = menus.join(kept, "restaurant_id").join(gone, menus["category"] == gone["excluded_category"], "left_anti")
    canonical = aliases.groupBy("alias_name").agg(F.max("canonical_name").alias("canonical_dish"))
    keyed = x.withColumn("key", T.lookup_key(F.col("name"), F.col("category"), synonyms, unescape)).where("key is not null")
    return keyed.join(canonical, F.col("key") == F.col("alias_name")).drop("key", "alias_name").withColumnsRenamed({"category": "menu_category", "name": "raw_menu_name"})


def funnel(rows: DataFrame) -> DataFrame:
    """Menu rows by the stage at which they leave."""
    return rows.groupBy("stage").agg(F.count("*").alias("n"))


def missing_canonicals(canonicals: DataFrame, rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Why a canonical name has no row: one of five classes from the hits of its aliases by stage."""
    hits = rows.select("key", "stage").join(aliases.select("alias_name", "canonical_name"), F.col("key") == F.col("alias_name")).groupBy("canonical_name")
    count = lambda s: F.count_if(F.col("stage") == s)
    sums = hits.agg(count("matched").alias("kept"), count("excluded_restaurant").alias("l1"), count("excluded_category").alias("l2"))
    x = canonicals.join(sums, "canonical_name", "left").na.fill(0, ["kept", "l1", "l2"])
    kind = F.when(F.col("kept") > 0, "present").when((F.col("l1") > 0) & (F.col("l2") > 0), "both_layers").when(F.col("l1") > 0, "restaurants_excluded").when(F.col("l2") > 0, "categories_excluded").otherwise("never_seen")
    return x.withColumn("diagnosis", kind)


def trace(menus: DataFrame, key: str, synonyms: Mapping[str, str]) -> DataFrame:
    """Raw names and categories behind a key."""
    found = menus.where(T.lookup_key(F.col("name"), F.col("category"), synonyms) == key)
    return found.groupBy("name", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def count_distribution(counts: DataFrame, shares: Iterable[float] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Nearest-rank quantiles of ``n``, from the number of names with each count rather than by ranking all names."""
    each = counts.groupBy("n").agg(F.count("*").alias("names"))
    total = counts.count()
    upto = each.withColumn("upto", F.sum("names").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(max(1, int(total * s))).alias("rank")) for s in shares])).alias("w")
    return upto.select("n", "names", "upto", wanted).where("w.rank <= upto and w.rank > upto - names").select("w.share", F.col("n").alias("value"))


def concentration(counts: DataFrame, tops: Iterable[int] = (10, 100, 1000, 5000, 10_000, 50_000, 100_000)) -> DataFrame:
    """Percent of all rows that the most frequent names have, for as many as there are.

    Names of one count weigh the same, so the distinct counts, which are few, are ranked.
    """
    each = counts.groupBy("n").agg(F.count("*").alias("names"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    x = each.withColumn("upto", F.sum("names").over(w)).withColumn("rows", F.sum(F.col("n") * F.col("names")).over(w))
    total, names = counts.agg(F.sum("n"), F.count("*")).first()
    top = F.explode(F.array(*[F.lit(t) for t in tops if t <= (names or 0)] or [F.lit(None).cast("int")])).alias("top")
    fit = x.select("n", "names", "upto", "rows", top).where("top <= upto and top > upto - names")
    return fit.select("top", (100 * (F.col("rows") - (F.col("upto") - F.col("top")) * F.col("n")) / F.lit(float(total or 1))).alias("percent"))


def top_raw_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The most frequent raw name of each key; ties go to the shorter, then the first in order."""
    counts = rows.groupBy(key, name).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.length(name), F.col(name))).alias("top_raw_name"))


def tier_bucket(tags: Column, tiers: Iterable[dict[str, str]], default: str) -> Column:
    """The bucket of the first tag that the first tier with any of them knows."""

    def first(tier: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for kv in sorted(tier.items()) for x in kv])
        return F.get(F.array_compact(F.transform(tags, lambda t: F.element_at(table, F.lower(t)))), F.lit(0))

    found = [first(tier) for tier in tiers]
    return F.coalesce(*found, F.lit(default))


def bucket_vote(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """The most frequent bucket of each key; ties go to the first in order."""
    counts = rows.groupBy(key, bucket).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(bucket, F.struct(-F.col("n"), F.col(bucket))).alias("bucket"))


def dish_context(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per canonical dish: top name, bucket, rows, distinct restaurants and its cluster id, where it has one."""
    counts = rows.groupBy("canonical_dish").agg(F.count("*").alias("n_rows"), F.countDistinct("restaurant_id").alias("n_restaurants"))
    return counts.join(top_raw_name(rows, "canonical_dish", "raw_menu_name"), "canonical_dish").join(bucket_vote(rows, "canonical_dish", "bucket"), "canonical_dish").join(ids.withColumnRenamed("canonical_name", "canonical_dish"), "canonical_dish", "left")


#: Upper ends of the count buckets (fixed values); the last bucket has none.
COUNT_BUCKETS = (1, 2, 3, 5, 10, 20, 50, 100, 500)


def count_buckets(counts: DataFrame) -> DataFrame:
    """Names and rows by bucket of their count."""
    bucket = F.coalesce(*[F.when(F.col("n") <= top, F.lit(k)) for k, top in enumerate(COUNT_BUCKETS)], F.lit(len(COUNT_BUCKETS)))
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("names"), F.sum("n").alias("rows"))


def next_dishes(context: DataFrame, done: DataFrame, key: str, count: str, top: int) -> DataFrame:
    """Of the ``top`` most frequent dishes those that are not done yet."""
    return context.orderBy(F.desc(count), key).limit(top).join(done.select(key).distinct(), key, "left_anti")
