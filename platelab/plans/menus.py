"""Queries over menu rows: keys, filters, categories, prices and the canonical index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import text as T
from platelab.operators import cleaning, index, rules

from . import inputs as I
from .registry import query


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda t: t <> '')"


def normal(x: str) -> str:
    out = f"lower(replace({x}, '&amp;', '&'))"
    for pattern, to in T.NORMAL_STEPS:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '(?i){quoted}', '{to}', 'g')"
    return f"array_to_string(list_sort({words(out)}), ' ')"


def fmt(x: str) -> str:
    quote = lambda p: p.replace("'", "''")
    hits = ", ".join(f"CASE WHEN regexp_matches({x}, '(?i)\\b{quote(p)}\\b') THEN '{t}' END" for p, t in T.FORMATS)
    return f"list_filter([{hits}], lambda t: t IS NOT NULL)"


def replaced(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(table.items()))
    return f"list_transform({x}, lambda t: CASE t {cases} ELSE t END)"


def singular(x: str) -> str:
    """Plurals of formats by the endings that a format takes."""
    ends = " ".join(f"WHEN t IN ('{f}s', '{f}es'{f", '{f[:-1]}ies'" if f.endswith('y') else ''}) THEN '{f}'" for _, f in T.FORMATS)
    return f"list_transform({x}, lambda t: CASE {ends} ELSE t END)"


KEYED = f"""WITH m AS (SELECT *, {normal("name")} AS base, {fmt("category")} AS f FROM {I.MENU_SQL}),
n AS (SELECT *, CASE WHEN len(list_distinct(f)) = 1 THEN f[1] END AS fmt FROM m),
w AS (SELECT *, CASE WHEN fmt IS NULL THEN base ELSE array_to_string(list_sort(list_distinct(list_append({singular(words("base"))}, fmt))), ' ') END AS with_format FROM n),
k AS (SELECT *, nullif(array_to_string(list_sort(list_distinct({replaced(words("with_format"), I.SYNONYMS)})), ' '), '') AS key FROM w)"""


@query("normalize_names", KEYED + " SELECT id, base FROM k")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.menus(spark, sf_dir).select("id", T.normalize(F.col("name")).alias("base"))


@query("infer_format", KEYED + " SELECT id, fmt, with_format FROM k")
def infer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("category")
    return I.menus(spark, sf_dir).select("id", T.format_of(c).alias("fmt"), T.normalize_with_format(F.col("name"), c).alias("with_format"))


@query("lookup_key", KEYED + " SELECT id, key FROM k")
def lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.menus(spark, sf_dir).select("id", T.lookup_key(F.col("name"), F.col("category"), I.SYNONYMS).alias("key"))


@query("name_counts", KEYED + " SELECT base AS name, count(*) AS n FROM k WHERE base <> '' GROUP BY base")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.count_names(I.menus(spark, sf_dir), T.normalize(F.col("name")))


@query("exclude_by_tags", f"SELECT id, category FROM {I.RESTAURANT_SQL} WHERE category IS NULL OR NOT list_has_any(list_transform(string_split(category, ','), lambda t: trim(t)), ['Grocery'])")
def exclude_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.restaurants(spark, sf_dir)
    return cleaning.exclude_by_tags(x, T.tags(F.col("category")), I.EXCLUDED_TAGS).select("id", "category")


@query("exclude_categories", f"SELECT id, category FROM {I.MENU_SQL} WHERE category IS NULL OR category NOT IN ('Drinks')")
def exclude_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("Drinks",), (None,)], "c string")
    return cleaning.exclude_values(I.menus(spark, sf_dir), "category", gone).select("id", "category")


@query("tag_counts", f"SELECT value, count(*) AS n, 'single' AS kind FROM (SELECT trim(unnest(string_split(category, ','))) AS value FROM {I.RESTAURANT_SQL}) WHERE value <> '' GROUP BY value UNION ALL SELECT category, count(*), 'combined' FROM {I.RESTAURANT_SQL} WHERE category <> '' GROUP BY category")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.tag_counts(I.restaurants(spark, sf_dir), "category")


#: Sentences of all whole documents as names, and what the passages of another table make of rules.
SENTENCE = "trim(regexp_replace(lower(s), '[^a-zà-ÿ0-9]+', ' ', 'g'))"
SENTENCES = f"(SELECT doc_id * 100000 + i AS id, {SENTENCE} AS name FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS i FROM documents))"
PASSAGE_SENTENCES = f"(SELECT item_id, {SENTENCE} AS name FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\n]')) AS s FROM benchmark))"
PASSAGE_WORDS = "(SELECT item_id * 1000 + i AS place, w, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS next FROM (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-zà-ÿ0-9]+', ' ', 'g')), ' ') AS w FROM benchmark)))"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = I.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.\n]")).alias("i", "s"))
    return each.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("id"), _plain(F.col("s")).alias("name"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-zà-ÿ0-9]+", " "))


def passage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each two words that follow one another in a passage: several hundred and more."""
    w = I.read(spark, sf_dir, "benchmark").select("item_id", F.split(_plain(F.col("text")), " ").alias("w"))
    two = w.select("item_id", F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("i", "p")).where("p.b is not null")
    at = (F.col("item_id") * 1000 + F.col("i") + 1).alias("rule")
    verdict = F.when(F.col("item_id") % 3 == 0, "review").otherwise("drop").alias("verdict")
    words = F.array(F.concat("p.a", F.lit(" "), "p.b")).alias("words")
    return two.select(at, verdict, F.concat("p.a", F.lit("+"), "p.b").alias("reason"), words, F.lit(None).cast("string").alias("pattern"))


@query(
    "fragment_filter",
    f"""WITH x AS (SELECT id, {words("name")} AS w FROM {SENTENCES}), y AS (SELECT id, len(w) AS n, list_transform(list_distinct(w), lambda t: len(list_filter(w, lambda u: u = t))) AS c FROM x)
SELECT id, n > 12 OR coalesce(list_max(c), 0) >= 3 OR len(list_filter(c, lambda v: v >= 2)) >= 2 AS fragment FROM y""",
)
def fragment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("id", T.is_fragment(F.col("name")).alias("fragment"))


@query(
    "flag_names",
    f"""WITH k AS (SELECT * FROM {SENTENCES}), t AS (SELECT *, {words("name")} AS w FROM k), p AS (SELECT * FROM {PASSAGE_WORDS}), l AS (SELECT DISTINCT w FROM p WHERE length(w) <= 4),
q AS (SELECT DISTINCT w || ' ' || next AS two FROM p WHERE next IS NOT NULL), o AS (SELECT id, unnest(w) AS w FROM t), r AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE w IN (SELECT w FROM l) AND length(w) <= 3) AS x FROM o GROUP BY 1),
b AS (SELECT DISTINCT id FROM (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS two FROM t) WHERE two IN (SELECT two FROM q))
SELECT id, CASE WHEN len(w) = 0 THEN 'x' WHEN len(w) = 1 THEN CASE WHEN w[1] IN (SELECT w FROM l) THEN CASE WHEN length(w[1]) <= 3 THEN 'x' ELSE '?' END WHEN length(w[1]) <= 2 AND NOT regexp_matches(w[1], '^\\d+$') THEN 'x' ELSE '' END
 WHEN name IN (SELECT name FROM {PASSAGE_SENTENCES}) OR r.x = r.n OR b.id IS NOT NULL THEN 'x' ELSE '' END AS flag FROM t LEFT JOIN r USING (id) LEFT JOIN b USING (id)""",
)
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = I.read(spark, sf_dir, "benchmark")
    listed = passages.select(F.explode(F.split(_plain(F.col("text")), " ")).alias("word")).where("length(word) <= 4").distinct()
    listed = listed.withColumn("flag", F.when(F.length("word") <= 3, "x").otherwise("?"))
    phrases = passages.select(F.explode(F.split("text", "[.\n]")).alias("s")).select(_plain(F.col("s")).alias("phrase"))
    return rules.flagged(_sentences(spark, sf_dir), "id", "name", listed, phrases, passage_rules(spark, sf_dir)).select("id", "flag")


@query(
    "category_mapping",
    """WITH v AS (SELECT CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, 'es & ', p_type, 's') WHEN 1 THEN concat(p_brand, 'es  and ', lower(p_type), 's') WHEN 2 THEN concat(p_brand, 'es + ', p_type) ELSE concat(p_brand, 'es and ', p_type) END AS s FROM part),
c AS (SELECT s AS spelling, count(*) AS n, regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '\\s*&\\s*', ' and ', 'g'), '\\s*\\+\\s*', ' and ', 'g'), '\\s+', ' ', 'g') AS k FROM v GROUP BY s),
t AS (SELECT k, unnest(string_split(k, ' ')) AS w, generate_subscripts(string_split(k, ' '), 1) AS i FROM (SELECT DISTINCT k FROM c)),
g AS (SELECT k, string_agg(CASE WHEN length(w) < 4 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN regexp_matches(w, '(ches|shes|xes|sses|zes|oes)$') THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END, ' ' ORDER BY i) AS s FROM t GROUP BY k),
f AS (SELECT k, first(spelling ORDER BY n DESC, spelling) AS winner, sum(n) AS n FROM c GROUP BY k),
z AS (SELECT s, first(winner ORDER BY n DESC, winner) AS canonical FROM f JOIN g USING (k) GROUP BY s)
SELECT spelling, n, canonical FROM c JOIN g USING (k) JOIN z USING (s)""",
)
def category_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = "CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, 'es & ', p_type, 's') WHEN 1 THEN concat(p_brand, 'es  and ', lower(p_type), 's') WHEN 2 THEN concat(p_brand, 'es + ', p_type) ELSE concat(p_brand, 'es and ', p_type) END AS s"
    return cleaning.canonical_mapping(I.read(spark, sf_dir, "part").selectExpr(spelling), "s")


@query(
    "classify_categories",
    f"SELECT id, CASE WHEN regexp_matches(lower(coalesce(category, '')), 'drink') THEN 'exclude' WHEN regexp_matches(lower(coalesce(category, '')), 'bowl|wrap') THEN 'ambiguous' ELSE 'keep' END AS verdict, CASE WHEN regexp_matches(lower(coalesce(category, '')), 'drink') THEN 'drinks' WHEN regexp_matches(lower(coalesce(category, '')), 'bowl|wrap') THEN 'formats' END AS label FROM {I.MENU_SQL}",
)
def classify_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.classify_categories(I.menus(spark, sf_dir), "category", [("drink", "drinks"), (r"chocolate(?!\s*chip)", "sweets")], [("bowl|wrap", "formats")]).select("id", "verdict", "label")


@query("price_parse", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 3 = 1 THEN NULL ELSE -p_retailprice END AS price_usd FROM part")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat(p_retailprice, ' USD') WHEN 1 THEN concat(p_retailprice, ' EUR') ELSE concat(-p_retailprice, ' USD') END AS p")
    return x.select("p_partkey", T.parse_price(F.col("p")).alias("price_usd"))


@query("remap_tags", f"SELECT id, CASE WHEN category IS NOT NULL THEN array_to_string(list_transform(list_filter(string_split(category, ','), lambda t: trim(t) <> ''), lambda t: CASE trim(t) WHEN 'Bar' THEN 'Bars' ELSE trim(t) END), ', ') END AS new_tags FROM {I.RESTAURANT_SQL}")
def remap_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("Bar", "Bars")], "spelling string, canonical string")
    return cleaning.remap_tags(I.restaurants(spark, sf_dir), "category", mapping, "id").select("id", "new_tags")


ALIASES = f"(SELECT key AS alias_name, concat('dish ', substr(key, 1, 6)) AS canonical_name FROM k WHERE key IS NOT NULL AND id % 5 <> 4 GROUP BY key)"
STAGED = KEYED + f""", a AS {ALIASES}, r AS {I.RESTAURANT_SQL}, s AS (SELECT k.id, k.restaurant_id, k.category, k.name, k.price_usd, r.name AS restaurant_name, a.canonical_name,
 CASE WHEN r.id IS NULL OR (r.category IS NOT NULL AND list_has_any(list_transform(string_split(r.category, ','), lambda t: trim(t)), ['Grocery'])) THEN 'excluded_restaurant' WHEN k.category = 'Drinks' THEN 'excluded_category' WHEN a.canonical_name IS NULL THEN 'no_match' ELSE 'matched' END AS stage
 FROM k LEFT JOIN r ON k.restaurant_id = r.id LEFT JOIN a ON k.key = a.alias_name)"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = I.menus(spark, sf_dir).where("id % 5 <> 4").select(T.lookup_key(F.col("name"), F.col("category"), I.SYNONYMS).alias("alias_name")).where("alias_name is not null").distinct()
    return keys.select("alias_name", F.concat(F.lit("dish "), F.substring("alias_name", 1, 6)).alias("canonical_name"))


def _drinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Drinks",)], "c string")


@query("canonical_index", STAGED + " SELECT canonical_name AS canonical_dish, count(*) AS n_rows, count(DISTINCT restaurant_id) AS n_restaurants, round(sum(price_usd), 2) AS price_sum FROM s WHERE stage = 'matched' GROUP BY 1")
def canonical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = index.build_index(I.menus(spark, sf_dir), I.restaurants(spark, sf_dir), I.EXCLUDED_TAGS, _drinks(spark), _aliases(spark, sf_dir), I.SYNONYMS)
    return x.groupBy("canonical_dish").agg(F.count("*").alias("n_rows"), F.countDistinct("restaurant_id").alias("n_restaurants"), F.round(F.sum("price_usd"), 2).alias("price_sum"))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.staged(I.menus(spark, sf_dir), I.restaurants(spark, sf_dir), I.EXCLUDED_TAGS, _drinks(spark), _aliases(spark, sf_dir), I.SYNONYMS)


@query("index_funnel", STAGED + " SELECT stage, count(*) AS n FROM s GROUP BY stage")
def index_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.funnel(_staged(spark, sf_dir))


@query(
    "missing_canonicals",
    STAGED
    + """, h AS (SELECT canonical_name, count(*) FILTER (WHERE stage = 'matched') AS kept, count(*) FILTER (WHERE stage = 'excluded_restaurant') AS l1, count(*) FILTER (WHERE stage = 'excluded_category') AS l2 FROM s WHERE canonical_name IS NOT NULL GROUP BY 1)
SELECT canonical_name, CASE WHEN kept > 0 THEN 'present' WHEN l1 > 0 AND l2 > 0 THEN 'both_layers' WHEN l1 > 0 THEN 'restaurants_excluded' WHEN l2 > 0 THEN 'categories_excluded' ELSE 'never_seen' END AS diagnosis FROM (SELECT DISTINCT canonical_name FROM a) LEFT JOIN h USING (canonical_name)""",
)
def missing_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = _aliases(spark, sf_dir)
    return index.missing_canonicals(aliases.select("canonical_name").distinct(), _staged(spark, sf_dir), aliases).select("canonical_name", "diagnosis")


@query(
    "top_raw_name",
    STAGED + """, c AS (SELECT canonical_name, name, count(*) AS n FROM s WHERE stage = 'matched' GROUP BY ALL) SELECT canonical_name AS canonical_dish, first(name ORDER BY n DESC, length(name), name) AS top_raw_name FROM c GROUP BY 1""",
)
def top_raw_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_raw_name(_staged(spark, sf_dir).where("stage = 'matched'"), "canonical_dish", "name")


@query(
    "bucket_vote",
    f"""WITH b AS (SELECT s_nationkey, CASE WHEN category IS NULL THEN 'Other' WHEN list_contains(list_transform(string_split(category, ','), lambda t: lower(trim(t))), 'thai') THEN 'Asian' WHEN list_contains(list_transform(string_split(category, ','), lambda t: lower(trim(t))), 'burgers') THEN 'American' WHEN list_contains(list_transform(string_split(category, ','), lambda t: lower(trim(t))), 'pizza') THEN 'Italian' ELSE 'Other' END AS bucket FROM {I.RESTAURANT_SQL} r JOIN supplier ON s_suppkey = r.id),
c AS (SELECT s_nationkey, bucket, count(*) AS n FROM b GROUP BY ALL) SELECT s_nationkey, first(bucket ORDER BY n DESC, bucket) AS bucket FROM c GROUP BY 1""",
)
def bucket_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [{"thai": "Asian"}, {"burgers": "American", "pizza": "Italian"}]
    x = I.read(spark, sf_dir, "supplier").join(I.restaurants(spark, sf_dir), F.col("s_suppkey") == F.col("id"))
    return index.bucket_vote(x.withColumn("bucket", index.tier_bucket(T.tags(F.col("category")), tiers, "Other")), "s_nationkey", "bucket")


@query("equal_chunks", "SELECT p_partkey, CAST(floor((row_number() OVER (ORDER BY p_name, p_partkey) - 1) / ceil((SELECT count(*) FROM part) / 7.0)) AS INT) AS chunk FROM part")
def equal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.equal_chunks(I.read(spark, sf_dir, "part"), [F.col("p_name"), F.col("p_partkey")], 7).select("p_partkey", "chunk")


@query("html_unescape")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "pages")
    return x.select("page_id", F.length(T.html_unescape(F.col("html"))).alias("n"))


@query("html_entities", "SELECT p_partkey, concat(p_name, ' & \"', p_type, '\" <', CASE WHEN p_size % 2 = 0 THEN 'é' ELSE '&nosuch;' END, '>', chr(160), '''') AS name FROM part")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities escaped up to three times, in either case, and one that is none."""
    odd = F.when(F.col("p_size") % 2 == 0, "&amp;eacute;").otherwise("&amp;nosuch;")
    text = F.concat(F.col("p_name"), F.lit(" &amp;amp;AMP; &QUOT;"), F.col("p_type"), F.lit("&amp;quot; &LT;"), odd, F.lit("&gt;&NBSP;&#39;"))
    return I.read(spark, sf_dir, "part").select("p_partkey", T.html_unescape(text).alias("name"))
