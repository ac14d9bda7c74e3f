"""Queries over dishes: context, factors, nutrients, classes, trees, curves and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import scores as S
from platelab.functions import text as T
from platelab.operators import flexibility as X
from platelab.operators import density, graphs, impact, index, linkage, manifold, nutrition, statistics
from platelab.operators.cleaning import numbered
from platelab.session import checkpointed

from . import inputs as I
from .registry import query
from .statistics import wq

INDEXED = "p_name AS canonical_dish, p_partkey % 37 AS restaurant_id, concat(p_name, ' ', p_size % 4) AS raw_menu_name, p_type AS bucket"


@query(
    "dish_context",
    f"""WITH r AS (SELECT {INDEXED} FROM part), t AS (SELECT canonical_dish, first(raw_menu_name ORDER BY n DESC, length(raw_menu_name), raw_menu_name) AS top FROM (SELECT canonical_dish, raw_menu_name, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
v AS (SELECT canonical_dish, first(bucket ORDER BY n DESC, bucket) AS bucket FROM (SELECT canonical_dish, bucket, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1), c AS (SELECT canonical_dish, count(*) AS n_rows, count(DISTINCT restaurant_id) AS n_restaurants FROM r GROUP BY 1)
SELECT canonical_dish, n_rows, n_restaurants, top AS top_raw_name, bucket, CASE WHEN canonical_dish NOT LIKE 'hot%' THEN length(canonical_dish) END AS cluster_id FROM c JOIN t USING (canonical_dish) JOIN v USING (canonical_dish)""",
)
def dish_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.read(spark, sf_dir, "part").selectExpr(*INDEXED.replace("concat(p_name, ' ', p_size % 4)", "p_name || ' ' || p_size % 4").split(", "))
    ids = rows.select(F.col("canonical_dish").alias("canonical_name")).distinct().where("canonical_name NOT LIKE 'hot%'").withColumn("cluster_id", F.length("canonical_name").cast("long"))
    return index.dish_context(rows, ids).select("canonical_dish", "n_rows", "n_restaurants", "top_raw_name", "bucket", "cluster_id")


@query("json_replies", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_name END AS dish, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size END AS grams FROM part")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.to_json(F.struct(F.col("p_name").alias("dish"), F.col("p_size").alias("grams")))
    k = F.col("p_partkey") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is:\n"), whole, F.lit("\nDone."))).when(k == 2, whole).otherwise("no answer")
    parsed = F.from_json(T.strip_code_fence(reply), "dish string, grams int")
    return I.read(spark, sf_dir, "part").select("p_partkey", parsed.alias("x")).select("p_partkey", "x.dish", "x.grams")


@query("next_dishes", "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 100 AND p_partkey % 3 <> 0")
def next_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return index.next_dishes(p, p.where("p_partkey % 3 = 0"), "p_partkey", "p_size", 100)


TERMS = {"red rod": ("bar", "stick"), "hot gear": ("cog",), "cold": ("frost",)}


@query("expand_query", "SELECT p_partkey, CASE WHEN p_name = 'red rod' THEN 'bar|stick' WHEN p_name = 'hot gear' THEN 'cog' ELSE '' END AS terms FROM part")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.upper("p_name"), F.when(F.col("p_size") % 2 == 0, " (fresh)").otherwise(""))
    return I.read(spark, sf_dir, "part").select("p_partkey", F.array_join(impact.expand_query(name, TERMS), "|").alias("terms"))


VECTOR_HITS, WORD_HITS = "p_brand AS item, p_name AS name, CAST(p_size AS DOUBLE) / 50 AS score", "p_brand AS item, upper(p_name) AS name"


@query(
    "candidate_union",
    f"WITH u AS (SELECT {VECTOR_HITS}, 0 AS kind FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {WORD_HITS}, 0.0, 1 FROM part) SELECT item, lower(name) AS key, min(kind) AS kind, max(score) FILTER (WHERE kind = 0) IS NOT NULL AS by_vector, coalesce(max(score) FILTER (WHERE kind = 0), 0) AS score FROM u GROUP BY ALL",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    x = impact.union_candidates(p.where("p_partkey % 2 = 0").selectExpr(*VECTOR_HITS.split(", ")), p.selectExpr(*WORD_HITS.split(", ")))
    return x.select("item", F.lower("name").alias("key"), "kind", (F.col("kind") == 0).alias("by_vector"), "score")


def _french(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the first five categories; one value of each is missing."""
    names = list(impact.IMPACT_NAMES)[:5]
    cols = [F.when(F.col("p_partkey") % 7 != k, F.col("p_size") * (k + 1) / 8).alias(n) for k, n in enumerate(names)]
    return I.read(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_partkey"), F.lit(" ")).alias("LCI Name"), *cols, F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("farm"))


@query(
    "impact_table",
    "SELECT concat(p_name, ' ', p_partkey) AS product, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 8 END, 0) AS climate_change, coalesce(CASE WHEN p_partkey % 7 <> 1 THEN p_size * 2 / 8 END, 0) AS ozone_depletion, coalesce(CASE WHEN p_partkey % 7 <> 4 THEN p_size * 5 / 8 END, 0) AS particulate_matter, 0::DOUBLE AS water_use FROM part",
)
def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impact_table(_french(spark, sf_dir), "LCI Name", "farm").select("product", "climate_change", "ozone_depletion", "particulate_matter", "water_use")


@query("breakdown_rows", f"WITH r AS {I.ROWS_SQL}, f AS {I.FACTORS_SQL} SELECT recipe_id, (row_number() OVER (PARTITION BY recipe_id ORDER BY grams * ghg DESC, position))::INT AS place, ingredient, round(grams * ghg, 6) AS ghg_g FROM r JOIN f USING (ingredient)")
def breakdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = impact.breakdown(I.recipe_rows(spark, sf_dir), I.factors(spark, sf_dir)).select("recipe_id", F.posexplode("ingredients").alias("at", "i"))
    return x.select("recipe_id", (F.col("at") + 1).alias("place"), "i.ingredient", F.round("i.ghg_g", 6).alias("ghg_g"))


@query("food_tables", "SELECT p_partkey AS fdc_id, p_name AS description, 'foundation' AS source FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey + 1000000, p_name, 'survey' FROM part UNION ALL SELECT p_partkey + 2000000, p_brand, 'legacy' FROM part")
def food_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    a = p.selectExpr("p_partkey AS fdc_id", "p_name AS description", "CASE WHEN p_type = 'PROMO' THEN 'foundation_food' ELSE 'sample' END AS data_type")
    return nutrition.foods((a, "foundation", "foundation_food"), (p.selectExpr("p_partkey + 1000000 AS fdc_id", "p_name AS description"), "survey", None), (p.selectExpr("p_partkey + 2000000 AS fdc_id", "p_brand AS description"), "legacy", None))


@query("food_categories", "SELECT p_partkey AS fdc_id, CASE WHEN p_size % 3 = 0 AND p_size < 40 THEN concat('category ', p_size) WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS fdc_category FROM part")
def food_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    coded = p.where("p_size % 3 = 0").selectExpr("p_partkey AS fdc_id", "p_size AS category_id")
    codes = p.where("p_size < 40").selectExpr("p_size AS category_id", "concat('category ', p_size) AS description").distinct()
    return nutrition.with_category(p.selectExpr("p_partkey AS fdc_id"), p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS fdc_id", "p_type AS category"), coded, codes)


@query("picked_index", "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL WHEN p_size % 13 = 0 THEN 1 WHEN p_size % 13 <= 10 THEN p_size % 13 END AS pick FROM part")
def picked_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("p_size") == 7, "none of them").otherwise(F.concat(F.lit("Answer: "), (F.col("p_size") % 13).cast("string")))
    return I.read(spark, sf_dir, "part").select("p_partkey", nutrition.pick_index(reply, F.lit(10)).alias("pick"))


CLASSES = "CASE WHEN ingredient LIKE '%ring%' THEN 'cheese' WHEN ingredient LIKE '%bolt%' THEN 'fat' WHEN ingredient LIKE '%gear%' THEN 'other' END"


@query(
    "dominant_food",
    f"WITH r AS {I.ROWS_SQL}, k AS (SELECT *, {CLASSES} AS class, sum(grams) OVER (PARTITION BY recipe_id) AS mass FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY grams DESC, position, ingredient) AS n FROM k WHERE class IS NOT NULL) SELECT recipe_id, ingredient, class, round(grams / mass, 6) AS share FROM o WHERE n = 1",
)
def dominant_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.recipe_rows(spark, sf_dir)
    table = rows.select("ingredient").distinct().withColumn("class", F.expr(CLASSES)).where("class IS NOT NULL")
    return nutrition.dominant_food(rows, table).withColumn("share", F.round("share", 6))


SAID = "CASE p_size % 9 WHEN 0 THEN ' Water ' WHEN 1 THEN 'Mineral Water 1l' WHEN 2 THEN 'Iced Tea' WHEN 3 THEN 'coffee cake' WHEN 4 THEN 'Mango Smoothie' WHEN 5 THEN 'juice glazed ribs' WHEN 6 THEN 'milk shaken' WHEN 7 THEN 'Cola' ELSE p_name END"


@query(
    "food_kinds",
    "SELECT p_partkey, CASE WHEN p_size % 9 IN (0, 1, 2, 4, 7) THEN 'beverage' WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'cheese' WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 'fat' ELSE 'general' END AS kind, p_size % 9 IN (0, 1) AS water FROM part",
)
def food_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dominant = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'cheese' WHEN 1 THEN 'fat' ELSE 'other' END")
    share = F.when(F.col("p_partkey") % 2 == 0, 0.6).otherwise(0.5)
    return I.read(spark, sf_dir, "part").select("p_partkey", S.food_kind(F.expr(SAID), dominant, share).alias("k")).select("p_partkey", "k.*")


@query("ingredient_nutrition", f"WITH r AS {I.ROWS_SQL}, o AS (SELECT lower(ingredient) AS ingredient, count(*) AS occurrences FROM r GROUP BY 1) SELECT ingredient, occurrences, ingredient LIKE '% 3' AS unmatched, CASE WHEN ingredient NOT LIKE '% 3' THEN length(ingredient) * 10.0::DOUBLE END AS energy_kcal FROM o")
def ingredient_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = impact.unique_ingredients(I.recipe_rows(spark, sf_dir).withColumn("at", F.col("recipe_id") * 100 + F.col("position")), "ingredient", "at").select(F.col("key").alias("ingredient"), "occurrences")
    matches = rows.where("ingredient NOT LIKE '% 3'").select("ingredient", F.length("ingredient").alias("fdc_id"), F.lit(False).alias("unmatched"))
    contents = matches.select("fdc_id").distinct().withColumn("energy_kcal", F.col("fdc_id") * 10.0)
    return nutrition.ingredient_table(rows, matches, contents).select("ingredient", "occurrences", "unmatched", "energy_kcal")


@query("manifold_join", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 4 <> 0")
def manifold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    return nutrition.manifold(p.select("p_partkey", "p_name"), p.where("p_partkey % 4 <> 0").select("p_partkey", "p_retailprice"), "p_partkey", "p_partkey")[0]


@query("manifold_missing", "SELECT count(*) AS missing FROM part WHERE p_partkey % 4 = 0")
def manifold_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    return nutrition.manifold(p.select("p_partkey"), p.where("p_partkey % 4 <> 0").select("p_partkey", "p_retailprice"), "p_partkey", "p_partkey")[1]


@query("usable_dishes", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000 AND o_custkey % 5 >= 2")
def usable_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN '' END AS error", "greatest(o_totalprice - 1000, 0) AS mass", "o_custkey % 5 AS total_count")
    return manifold.usable_dishes(x).select("o_orderkey")


@query("vocabulary_index", "SELECT value, (row_number() OVER (ORDER BY value) - 1)::BIGINT AS place FROM (SELECT DISTINCT concat(p_name, ' ', p_size % 7) AS value FROM part)")
def vocabulary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.vocabulary(I.read(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_size % 7) AS name"), "name").withColumn("place", F.col("place").cast("long"))


@query("primary_protein", f"""WITH r AS {I.ROWS_SQL}, c AS (SELECT *, CASE WHEN ingredient LIKE '%rod%' THEN NULL WHEN ingredient LIKE '%ring%' THEN 'fish' WHEN ingredient LIKE '%bolt%' THEN 'beans' WHEN ingredient LIKE '%gear%' THEN 'egg' END AS class FROM r), s AS (SELECT recipe_id, class, sum(grams) AS g, min(position) AS p FROM c WHERE class IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT recipe_id FROM r)
SELECT recipe_id, coalesce((SELECT first(class ORDER BY g DESC, p, class) FROM s WHERE s.recipe_id = k.recipe_id), 'none') AS class FROM k""")
def primary_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    food = F.expr("CASE WHEN ingredient LIKE '%rod%' THEN 'Fish sauce' WHEN ingredient LIKE '%ring%' THEN 'Shrimp' WHEN ingredient LIKE '%bolt%' THEN 'lentils' WHEN ingredient LIKE '%gear%' THEN 'Egg white' WHEN ingredient LIKE '%widget%' THEN 'green beans' ELSE 'eggplant' END")
    kind = manifold.class_of(food, manifold.PROTEINS, manifold.NO_PROTEIN, manifold.PROTEIN_BUT)
    return manifold.primary_class(I.recipe_rows(spark, sf_dir), kind)


@query("primary_carb", f"""WITH r AS {I.ROWS_SQL}, c AS (SELECT *, CASE WHEN ingredient LIKE '%ring%' THEN 'potato' WHEN ingredient LIKE '%bolt%' THEN 'wheat' WHEN ingredient LIKE '%gear%' THEN 'rice' END AS class FROM r), s AS (SELECT recipe_id, class, sum(grams) AS g, min(position) AS p FROM c WHERE class IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT recipe_id FROM r)
SELECT recipe_id, coalesce((SELECT first(class ORDER BY g DESC, p, class) FROM s WHERE s.recipe_id = k.recipe_id), 'none') AS class FROM k""")
def primary_carb(spark: SparkSession, sf_dir: str) -> DataFrame:
    food = F.expr("CASE WHEN ingredient LIKE '%ring%' THEN 'Sweet potato, corn' WHEN ingredient LIKE '%bolt%' THEN 'Pita' WHEN ingredient LIKE '%gear%' THEN 'brown rice' WHEN ingredient LIKE '%rod%' THEN 'rice vinegar' ELSE 'salt' END")
    return manifold.primary_class(I.recipe_rows(spark, sf_dir), manifold.class_of(food, manifold.CARBS, manifold.NO_CARB))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "embeddings").selectExpr("vec_id AS idx", "label", "CAST(embedding AS array<double>) AS vector")


@query("ward_tree")
def ward_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: merges depend on one another. A test compares them with plain computation."""
    return linkage.ward_tree(_embedded(spark, sf_dir)).withColumn("height", F.round("height", 6))


#: Numbers of clades of the views (fixed values).
CUTS = (24, 150, 800)


@query("tree_clades")
def tree_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL, as for ``ward_tree``: the most frequent members of each clade of each cut."""
    x = _embedded(spark, sf_dir)
    cut = linkage.clades(checkpointed(linkage.ward_tree(x)), CUTS)
    named = numbered(x.selectExpr("idx", "concat('dish ', idx) AS name", "idx * 7 % 97 + 1 AS count"), [F.col("idx")]).withColumnRenamed("place", "leaf")
    rows = cut.join(named.drop("idx"), "leaf").select(F.struct("cut", "clade").alias("clade"), "name", "count")
    return manifold.clade_members(rows).select("clade.*", "rank", "name", "count", "size")


@query("merged_regions")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL, as for ``ward_tree``: average linkage of centres up to a distance, then names that none has twice."""
    c = I.read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("x"), F.avg(F.col("c_custkey") % 1000).alias("y"), F.count("*").alias("n"))
    c = numbered(c, [F.col("c_nationkey"), F.col("c_mktsegment")]).withColumn("idx", F.col("place").cast("long"))
    regions = checkpointed(c.join(linkage.average_linkage(c.select("idx", F.array("x", "y").alias("vector")), 85.0), "idx"))
    wishes = regions.groupBy("region").agg(F.sum("n").cast("double").alias("area"), F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("most"), F.min("c_nationkey").alias("nation"))
    names = F.array(F.lower("most"), F.concat(F.lower("most"), F.lit(" "), F.col("nation")), F.concat(F.lit("isle "), F.col("region")))
    return regions.join(linkage.unique_names(wishes.select("region", "area", names.alias("names"))), "region").select("idx", "region", "name")


@query("density_regions")
def density_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL, as for ``ward_tree``: ten dense places, and every 13th point anywhere."""
    near = "p_size % 10 * 10 + CAST(p_partkey * 7919 % 1009 AS DOUBLE) / 500"
    x = I.read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS idx", f"CASE WHEN p_partkey % 13 = 0 THEN p_partkey * 31 % 997 / 10.0D ELSE {near} END AS x",
        "CASE WHEN p_partkey % 13 = 0 THEN p_partkey * 17 % 991 / 10.0D ELSE p_size % 3 * 30 + CAST(p_partkey * 6007 % 1013 AS DOUBLE) / 400 END AS y",
    )
    return density.density_regions(x)


LIKE = "SELECT vec_id AS idx, CASE WHEN vec_id % 2 = 0 THEN 'half' ELSE concat('k', vec_id % 11) END AS key, vec_id * 7 % 50 + 1 AS count"


@query(
    "semantic_merge",
    f"""WITH RECURSIVE e AS ({LIKE}, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), p AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j FROM e a JOIN e b ON a.key = b.key AND a.idx <> b.idx WHERE list_dot_product(a.v, b.v) >= 0.45),
r AS (SELECT idx, idx AS c FROM e UNION SELECT r.idx, p.j FROM r JOIN p ON r.c = p.i) SELECT r.idx, first(c ORDER BY count DESC, c) AS root, count(*) AS members FROM r JOIN e ON e.idx = c GROUP BY 1""",
)
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows share one key; the test vectors have no near copies, so the threshold is lower than usual."""
    x = I.read(spark, sf_dir, "embeddings").selectExpr(*LIKE.removeprefix("SELECT ").replace("AS idx, CASE", "AS idx; CASE").replace("AS key, vec_id", "AS key; vec_id").split("; "), "embedding AS vector")
    return graphs.semantic_merge(x, 0.45).select("idx", "root", "members")


@query("clade_labels", "SELECT p_partkey, concat('The ', p_name, CASE WHEN p_size % 2 = 0 THEN ' of' ELSE '' END) AS label FROM part")
def clade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" \"The '"), F.col("p_name"), F.lit("'."), F.when(F.col("p_size") % 2 == 0, " of more words\"").otherwise(" "))
    return I.read(spark, sf_dir, "part").select("p_partkey", manifold.clade_label(text).alias("label"))


@query("detail_records", "SELECT p.p_partkey AS cluster_id, p_name, n.lines AS lines, n.quantity AS quantity, CASE WHEN p.p_partkey % 3 = 0 THEN p_brand END AS brand FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) n ON l_partkey = p.p_partkey")
def detail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "cluster_id")
    sold = I.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cluster_id")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    x = manifold.detail_records(p.select("cluster_id", "p_name"), sold=sold, made=p.where("cluster_id % 3 = 0").select("cluster_id", "p_brand"))
    return x.select("cluster_id", "p_name", "sold.lines", "sold.quantity", F.col("made.p_brand").alias("brand"))


@query("overlaid_attributes", "SELECT p_partkey, -p_size AS health, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_type END AS protein FROM part")
def overlaid_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS yll", "CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS protein")
    return manifold.overlaid(x, "yll", ["protein"]).select("p_partkey", "health", "protein")


@query("tree_leaves", "SELECT n_regionkey AS parent, n_nationkey AS child, n_nationkey % 2 = 0 AS is_leaf, CASE WHEN n_nationkey % 2 = 0 THEN p_name END AS p_name FROM nation LEFT JOIN part ON p_partkey = n_nationkey")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.read(spark, sf_dir, "nation").selectExpr("n_regionkey AS parent", "n_nationkey AS child", "n_nationkey % 2 = 0 AS is_leaf")
    return manifold.enriched_leaves(edges, I.read(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "p_name"))


@query("name_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'gear') ORDER BY p_size DESC, concat(p_name, ' ', p_partkey) LIMIT 10")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.search(I.read(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_partkey) AS name", "p_size"), "name", "GEAR", "p_size", 10).select("p_partkey")


@query("nearest_point", "SELECT p_partkey AS idx FROM part WHERE (p_size - 25.3) * (p_size - 25.3) + (p_retailprice % 100 - 50.2) * (p_retailprice % 100 - 50.2) <= 400 ORDER BY (p_size - 25.3) * (p_size - 25.3) + (p_retailprice % 100 - 50.2) * (p_retailprice % 100 - 50.2), p_partkey LIMIT 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "CAST(p_size AS DOUBLE) AS x", "p_retailprice % 100 AS y")
    return manifold.nearest_point(x, 25.3, 50.2, 20.0).select("idx")


#: Radii of the curves (fixed values): each hundredth up to 0.3, then twelve up to 0.6.
RADII = tuple(round(0.01 * k, 4) for k in range(31)) + tuple(round(0.325 + 0.025 * k, 4) for k in range(12))
METRICS = "p_partkey AS idx, p_retailprice / 100 AS ghg, CAST(CASE WHEN p_size % 10 <> 0 THEN p_size END AS DOUBLE) AS water, CAST(p_size % 13 AS DOUBLE) AS land"
VALID = f"""WITH m AS (SELECT * FROM (SELECT {METRICS} FROM part) WHERE ghg > 0 AND water > 0 AND land > 0), e AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings WHERE vec_id IN (SELECT idx FROM m)),
p AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN a.idx = b.idx THEN 0 ELSE greatest(0, 1 - list_dot_product(a.v, b.v)) END AS d FROM e a, e b), r AS (SELECT unnest({list(RADII)}::DOUBLE[]) AS radius)"""


def _valid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = I.read(spark, sf_dir, "part").selectExpr(*METRICS.split(", "))
    for c in ("ghg", "water", "land"):
        m = statistics.clean_metric(m, c, True)
    v = I.read(spark, sf_dir, "embeddings").selectExpr("vec_id AS idx", "embedding AS vector").join(m.select("idx"), "idx", "left_semi")
    return v, m


@query(
    "footprint_curves",
    VALID + """, g AS (SELECT i, radius, count(*) AS n, (o.ghg - min(k.ghg)) / o.ghg AS ghg, (o.water - min(k.water)) / o.water AS water, (o.land - min(k.land)) / o.land AS land FROM p JOIN m o ON o.idx = i JOIN m k ON k.idx = j JOIN r ON d <= radius GROUP BY i, radius, o.ghg, o.water, o.land)
SELECT radius, round(avg(n), 6) AS mean_neighbors, quantile_cont(n, 0.5) AS median_neighbors, """ + ", ".join(f"round(avg({n}), 6) AS {n}_mean, round(quantile_cont({n}, 0.25), 6) AS {n}_p25, round(quantile_cont({n}, 0.5), 6) AS {n}_median, round(quantile_cont({n}, 0.75), 6) AS {n}_p75" for n in ("ghg", "water", "land")) + " FROM g GROUP BY radius",
)
def footprint_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, m = _valid(spark, sf_dir)
    c = X.curve(X.best_gains(vectors, m, ["ghg", "water", "land"], [], RADII), ["ghg", "water", "land"])
    return c.select(*[F.round(x, 6).alias(x) if x not in ("radius", "median_neighbors") else F.col(x) for x in c.columns])


@query("score_curve", VALID + ", g AS (SELECT i, radius, max(k.land) - o.land AS score FROM p JOIN m o ON o.idx = i JOIN m k ON k.idx = j JOIN r ON d <= radius GROUP BY i, radius, o.land) SELECT radius, round(avg(score), 6) AS score_mean, round(quantile_cont(score, 0.75), 6) AS score_p75 FROM g GROUP BY radius")
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, m = _valid(spark, sf_dir)
    c = X.curve(X.best_gains(vectors, m.select("idx", F.col("land").alias("score")), [], ["score"], RADII), ["score"])
    return c.select("radius", F.round("score_mean", 6).alias("score_mean"), F.round("score_p75", 6).alias("score_p75"))


CURVE = "(SELECT CAST(p_size % 5 AS DOUBLE) AS radius, p_retailprice AS gain, CAST(1 + p_partkey % 3 AS DOUBLE) AS w FROM part)"


@query(
    "weighted_curve",
    "SELECT radius, round(mean, 6) AS mean, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75 FROM (SELECT radius, sum(w * gain) / sum(w) AS mean FROM " + CURVE + " GROUP BY 1) JOIN (" + wq(CURVE, "radius", "gain", "w", "w", [0.25, 0.5, 0.75]) + ") USING (radius)",
)
def weighted_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("CAST(p_size % 5 AS DOUBLE) AS radius", "p_retailprice AS gain", "CAST(1 + p_partkey % 3 AS DOUBLE) AS w")
    return X.weighted_curve(x, "gain", "w").select("radius", F.round("mean", 6).alias("mean"), *[F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")])


@query("per_serving", "SELECT p_partkey, round(p_retailprice * p_size / 1000 / (1 + p_partkey % 4), 6) AS per_serving FROM part")
def per_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "part").select("p_partkey", F.round(statistics.per_serving(F.col("p_retailprice"), F.col("p_size"), 1 + F.col("p_partkey") % 4), 6).alias("per_serving"))


@query(
    "area_income",
    "WITH i AS (SELECT n_nationkey AS area, avg(c_acctbal) AS income FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 6 <> 0 GROUP BY 1), x AS (SELECT s_suppkey, s_nationkey AS area, income FROM supplier JOIN i ON area = s_nationkey) SELECT s_suppkey, area, round(income, 4) AS income FROM x WHERE income <= (SELECT quantile_cont(income, 0.9) FROM x)",
)
def area_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    incomes = I.read(spark, sf_dir, "customer").where("c_nationkey % 6 <> 0").groupBy(F.col("c_nationkey").alias("area")).agg(F.avg("c_acctbal").alias("income"))
    rows = I.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area"))
    return statistics.area_income(rows, incomes, "area", "income", 0.9).select("s_suppkey", "area", F.round("income", 4).alias("income"))


@query(
    "unified_table",
    "SELECT p_partkey, p_name, l.quantity AS last_quantity, o.price AS last_price FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) o ON o_custkey = p_partkey",
)
def unified_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = I.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = I.read(spark, sf_dir, "lineitem").selectExpr("l_partkey AS p_partkey", "l_quantity", "l_orderkey * 10 + l_linenumber AS at")
    orders = I.read(spark, sf_dir, "orders").selectExpr("o_custkey AS p_partkey", "o_totalprice", "o_orderkey AS at")
    return statistics.unified_table(base, [(lines, "p_partkey", "at", {"last_quantity": "l_quantity"}), (orders, "p_partkey", "at", {"last_price": "o_totalprice"})])


@query("clean_metric", "SELECT p_partkey FROM part WHERE p_partkey % 5 > 2")
def clean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS v")
    return statistics.clean_metric(x, "v", True).select("p_partkey")


@query(
    "dish_similarity",
    """WITH d AS (SELECT l_orderkey AS idx, l_partkey % 10 AS k, max(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT idx, count(*) AS n FROM d GROUP BY 1), p AS (SELECT o_orderkey AS i, o_orderkey + 1 AS j FROM orders WHERE o_orderkey + 1 IN (SELECT idx FROM d) AND o_orderkey IN (SELECT idx FROM d)),
b AS (SELECT i, j, count(*) AS common, sum(least(x.q, y.q)) AS mass FROM p JOIN d x ON x.idx = i JOIN d y ON y.idx = j AND y.k = x.k GROUP BY ALL)
SELECT i, j, round(coalesce(common, 0) / (a.n + c.n - coalesce(common, 0)), 6) AS jaccard, coalesce(mass, 0) AS shared_mass FROM p JOIN s a ON a.idx = i JOIN s c ON c.idx = j LEFT JOIN b USING (i, j)""",
)
def dish_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 10).alias("k")).agg(F.max("l_quantity").alias("q"))
    dishes = d.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("ingredients"))
    pairs = I.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "o_orderkey + 1 AS j")
    return statistics.similarity(pairs, dishes).select("i", "j", F.round("jaccard", 6).alias("jaccard"), "shared_mass")
