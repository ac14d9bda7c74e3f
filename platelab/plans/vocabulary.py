"""Queries over alias clusters: candidates, decisions and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import text as T
from platelab.operators import cleaning
from platelab.operators import vocabulary as V

from . import inputs as I
from .menus import replaced, words
from .registry import query

C = f"WITH c AS {I.CLUSTER_SQL}"
W = C + f", w AS (SELECT *, {words('canonical_name')} AS t FROM c)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with itself and, if its id is even, one more alias."""
    c = I.clusters(spark, sf_dir)
    extra = F.when(F.col("cluster_id") % 2 == 0, F.array(F.lit("self"), F.lit("fuzzy"))).otherwise(F.array(F.lit("self")))
    x = c.withColumn("method", F.explode(extra))
    return x.select("canonical_name", F.when(F.col("method") == "self", F.col("canonical_name")).otherwise(F.concat("canonical_name", F.lit("x"))).alias("alias_name"), F.col("total_count").alias("alias_count"), "cluster_id", "method")


A = C + """, al AS (SELECT canonical_name, canonical_name AS alias_name, total_count AS alias_count, cluster_id, 'self' AS method FROM c UNION ALL SELECT canonical_name, canonical_name || 'x', total_count, cluster_id, 'fuzzy' FROM c WHERE cluster_id % 2 = 0)"""


@query("cluster_summary", A + " SELECT cluster_id, max(canonical_name) AS canonical_name, count(*) AS n_aliases, sum(alias_count)::BIGINT AS total_count FROM al GROUP BY 1")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_aliases(spark, sf_dir))


@query("number_strip", W + " SELECT cluster_id, CASE WHEN len(l) < len(t) THEN array_to_string(list_sort(l), ' ') END AS stripped FROM (SELECT *, list_filter(t, lambda x: NOT regexp_matches(x, '(?i)^(\\d+|\\d+(pc|pcs)|pc|pcs|piece|pieces|inch|in|inches)$')) AS l FROM w)")
def number_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clusters(spark, sf_dir).select("cluster_id", T.strip_number_tokens(F.col("canonical_name")).alias("stripped"))


@query("token_hits", W + " SELECT cluster_id, list_min(list_filter(t, lambda x: x IN ('combo', 'sandwich', 'sub'))) AS reason FROM w WHERE list_has_any(t, ['combo', 'sandwich', 'sub'])")
def token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.token_hits(I.clusters(spark, sf_dir), ["combo", "sandwich", "sub"]).select("cluster_id", "reason")


@query("bare_formats", W + " SELECT cluster_id, canonical_name FROM w WHERE len(t) BETWEEN 1 AND 2 AND len(list_filter(t, lambda x: x NOT IN ('ring', 'plate', 'hot'))) = 0")
def bare_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bare_formats(I.clusters(spark, sf_dir), ["ring", "plate", "hot"]).select("cluster_id", "canonical_name")


def _decisions(cleaned: str) -> str:
    return W + f""", d AS (SELECT cluster_id, canonical_name, {cleaned} AS new_name FROM w), ch AS (SELECT * FROM d WHERE new_name <> canonical_name), th AS (SELECT canonical_name AS new_name, min(cluster_id) AS target_id FROM c GROUP BY 1),
j AS (SELECT ch.*, target_id, CASE WHEN target_id IS NOT NULL THEN 'merge' WHEN len({words('ch.new_name')}) >= 2 THEN 'rename' ELSE 'drop' END AS action FROM ch LEFT JOIN th USING (new_name))
SELECT cluster_id, action, target_id, CASE WHEN action = 'rename' THEN new_name END AS new_name FROM j"""


@query("single_letters", _decisions("array_to_string(list_filter(t, lambda x: NOT regexp_matches(x, '^[a-z]$')), ' ')"))
def single_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cleaned_decisions(I.clusters(spark, sf_dir), V.without_single_letters(F.col("canonical_name"))).select("cluster_id", "action", "target_id", "new_name")


@query("chain_tokens", _decisions("array_to_string(list_filter(t, lambda x: x NOT IN ('combo', 'by')), ' ')"))
def chain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cleaned_decisions(I.clusters(spark, sf_dir), V.without_words(F.col("canonical_name"), ["combo", "by"])).select("cluster_id", "action", "target_id", "new_name")


@query("doubled_tokens", _decisions("array_to_string(list_sort(list_filter(t, lambda x, i: x = 'ring' OR list_position(t, x) = i)), ' ')"))
def doubled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cleaned_decisions(I.clusters(spark, sf_dir), V.without_doubles(F.col("canonical_name"), ["ring"])).select("cluster_id", "action", "target_id", "new_name")


@query(
    "apply_single_letters",
    A
    + f""", d AS (SELECT cluster_id, canonical_name, array_to_string(list_filter({words('canonical_name')}, lambda x: NOT regexp_matches(x, '^[a-z]$')), ' ') AS new_name FROM c), j AS (SELECT d.cluster_id, d.new_name, t.cluster_id AS target_id, CASE WHEN t.cluster_id IS NOT NULL THEN 'merge' WHEN len({words('d.new_name')}) >= 2 THEN 'rename' ELSE 'drop' END AS action FROM d LEFT JOIN c t ON t.canonical_name = d.new_name WHERE d.new_name <> d.canonical_name)
SELECT CASE action WHEN 'merge' THEN new_name WHEN 'rename' THEN new_name ELSE canonical_name END AS canonical_name, CASE WHEN action = 'rename' AND alias_name = canonical_name THEN new_name ELSE alias_name END AS alias_name, alias_count, coalesce(CASE WHEN action = 'merge' THEN target_id END, cluster_id) AS cluster_id, CASE WHEN action = 'merge' AND alias_name = canonical_name THEN 'single_letter_merge' ELSE method END AS method
FROM al LEFT JOIN j USING (cluster_id) WHERE action IS NULL OR action <> 'drop'""",
)
def apply_single_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = _aliases(spark, sf_dir)
    return V.apply_decisions(aliases, V.cleaned_decisions(I.clusters(spark, sf_dir), V.without_single_letters(F.col("canonical_name"))), "replace_self", "single_letter_merge")


SYN = {"hoagie": "sub", "sandwich": "sub"}


@query(
    "synonym_merge",
    A
    + f""", k AS (SELECT cluster_id, canonical_name, array_to_string(list_sort(list_distinct({replaced(words('canonical_name'), SYN)})), ' ') AS key FROM c), s AS (SELECT cluster_id, sum(alias_count) AS total FROM al GROUP BY 1),
h AS (SELECT key, first(cluster_id ORDER BY total DESC, substr(canonical_name, 1, 1), cluster_id) AS head FROM k JOIN s USING (cluster_id) GROUP BY key)
SELECT key AS canonical_name, alias_name, alias_count, head AS cluster_id, CASE WHEN head <> cluster_id OR key <> al.canonical_name THEN 'synonym' ELSE method END AS method FROM al JOIN k USING (cluster_id) JOIN h USING (key)""",
)
def synonym_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.synonym_merge(_aliases(spark, sf_dir), SYN)


@query("synonym_impact", W + " SELECT word, count(*) AS clusters, sum(total_count)::BIGINT AS rows FROM (SELECT cluster_id, total_count, unnest(list_distinct(t)) AS word FROM w) WHERE word IN ('hoagie', 'sandwich') GROUP BY word")
def synonym_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.synonym_impact(I.clusters(spark, sf_dir), SYN).select("word", "clusters", "rows")


@query(
    "ingredient_flags",
    W
    + """, s AS (SELECT *, list_filter(t, lambda x: NOT regexp_matches(x, '(?i)^(\\d+|\\d+(pc|pcs)|pc|pcs|piece|pieces|inch|in|inches)$')) AS l FROM w), x AS (SELECT *, CASE WHEN len(l) < len(t) THEN array_to_string(list_sort(l), ' ') END AS st FROM s),
r AS (SELECT x.*, CASE WHEN len(t) = 1 AND canonical_name NOT IN ('rod') AND canonical_name IN ('ring', 'bolt') THEN 'bare_ingredient_1tok (' || canonical_name || ')' WHEN len(t) = 1 AND canonical_name NOT IN ('rod') THEN 'single_token_not_listed' WHEN canonical_name IN ('hot plate') THEN 'bare_ingredient_2tok' WHEN t[1] = 'by' THEN 'by_prefix_fragment'
 WHEN regexp_matches(canonical_name, '[0-9]') AND st IN (SELECT canonical_name FROM c) AND st <> canonical_name THEN 'redundant_with: ' || st WHEN regexp_matches(canonical_name, '[0-9]') AND st IS NOT NULL AND len(l) <= 1 THEN 'fragment_after_number_strip' WHEN regexp_matches(canonical_name, '[0-9]') THEN 'has_digit_no_match' ELSE 'ok' END AS reason FROM x)
SELECT cluster_id, CASE WHEN reason IN ('single_token_not_listed', 'has_digit_no_match') THEN 'review' WHEN reason = 'ok' THEN 'keep' ELSE 'drop' END AS verdict, reason FROM r""",
)
def ingredient_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ingredient_flags(I.clusters(spark, sf_dir), ["ring", "bolt"], ["rod"], ["hot plate"]).select("cluster_id", "verdict", "reason")


@query(
    "merge_candidates",
    W
    + """, x AS (SELECT cluster_id, total_count, list_distinct(t) AS t FROM w), s AS (SELECT * FROM x WHERE total_count <= 4 AND len(t) BETWEEN 2 AND 6), g AS (SELECT * FROM x WHERE total_count >= 5),
p AS (SELECT s.cluster_id AS source_id, g.cluster_id AS target_id, g.total_count AS target_count, len(list_intersect(s.t, g.t)) AS shared, len(list_intersect(s.t, g.t)) / len(s.t) AS ratio FROM s JOIN g ON s.cluster_id <> g.cluster_id AND len(g.t) <= 2 * len(s.t)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ratio DESC, target_count DESC, target_id) AS r FROM p WHERE ratio >= 0.6 AND shared > 0)
SELECT source_id, target_id, target_count, shared::BIGINT AS shared, round(ratio, 6) AS ratio FROM r WHERE r <= 3""",
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_candidates(I.clusters(spark, sf_dir), target_least=5, source_most=4).withColumn("ratio", F.round("ratio", 6))


@query(
    "rescue_candidates",
    W
    + """, x AS (SELECT cluster_id, total_count, list_distinct(t) AS t FROM w), p AS (SELECT d.cluster_id AS dropped_id, k.cluster_id AS target_id, (len(d.t) - len(k.t))::INT AS noise, k.total_count AS target_count FROM x d JOIN x k ON d.cluster_id % 2 = 1 AND k.cluster_id % 2 = 0 AND d.total_count >= 3 AND k.total_count >= 5 AND NOT list_contains(k.t, 'combo') AND len(list_intersect(d.t, k.t)) = len(k.t) AND len(k.t) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY dropped_id ORDER BY noise, target_count DESC, target_id) AS r FROM p WHERE noise BETWEEN 1 AND 2) SELECT dropped_id, target_id, noise, target_count FROM r WHERE r <= 3""",
)
def rescue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.clusters(spark, sf_dir)
    return V.rescue_candidates(c.where("cluster_id % 2 = 1"), c.where("cluster_id % 2 = 0"), ["combo"], 3, 5)


@query(
    "skeleton_pairs",
    W
    + """, k AS (SELECT *, array_to_string(list_filter(t, lambda x: x NOT IN ('sandwich', 'sandwiches', 'sub', 'subs')), ' ') AS skeleton, list_has_any(t, ['sandwich', 'sandwiches', 'sub', 'subs']) AS hit FROM w),
h AS (SELECT *, first_value(cluster_id) OVER (PARTITION BY skeleton ORDER BY total_count DESC, cluster_id) AS head, count(*) OVER (PARTITION BY skeleton) AS n, max(hit::INT) OVER (PARTITION BY skeleton) AS any_hit FROM k WHERE skeleton <> '')
SELECT cluster_id AS source_id, head AS target_id, skeleton FROM h WHERE n >= 2 AND any_hit = 1 AND head <> cluster_id""",
)
def skeleton_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.skeleton_pairs(I.clusters(spark, sf_dir))


@query("long_singletons", W + " SELECT cluster_id FROM w WHERE total_count = 1 AND len(t) >= 2 AND NOT list_has_any(t, ['sub'])")
def long_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.long_singletons(I.clusters(spark, sf_dir), ["sub"], 2).select("cluster_id")


@query(
    "apply_merges_two_hop",
    A
    + """, j AS (SELECT cluster_id AS source_id, cluster_id // 2 + 1 AS target_id FROM c WHERE cluster_id % 3 = 0 UNION ALL SELECT cluster_id, 1 FROM c WHERE cluster_id % 9 = 0), jc AS (SELECT source_id, target_id, c.total_count AS n FROM j JOIN c ON c.cluster_id = j.target_id WHERE source_id <> target_id),
b AS (SELECT source_id, first(target_id ORDER BY n DESC, target_id) AS target_id FROM jc GROUP BY 1), h AS (SELECT b.source_id, coalesce(o.target_id, b.target_id) AS target_id FROM b LEFT JOIN b o ON b.target_id = o.source_id WHERE o.target_id IS NULL OR o.target_id <> b.source_id)
SELECT coalesce(t.canonical_name, al.canonical_name) AS canonical_name, alias_name, alias_count, coalesce(h.target_id, al.cluster_id) AS cluster_id, CASE WHEN h.target_id IS NOT NULL THEN 'llm_merge' ELSE method END AS method FROM al LEFT JOIN h ON al.cluster_id = h.source_id LEFT JOIN c t ON t.cluster_id = h.target_id""",
)
def apply_merges_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.clusters(spark, sf_dir)
    pairs = c.where("cluster_id % 3 = 0").selectExpr("cluster_id AS source_id", "cluster_id div 2 + 1 AS target_id").union(c.where("cluster_id % 9 = 0").selectExpr("cluster_id", "1L"))
    judged = pairs.where("source_id <> target_id").join(c.selectExpr("cluster_id AS target_id", "total_count AS target_count"), "target_id").withColumn("verdict", F.lit("yes"))
    return V.apply_decisions(_aliases(spark, sf_dir), V.judged_merges(judged), "all_rows", "llm_merge")


VERDICTS = C + """, a AS (SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'KEEP' ELSE 'DROP' END AS v FROM c WHERE cluster_id % 7 <> 0), b AS (SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'DROP' ELSE 'KEEP' END AS v, CASE WHEN cluster_id % 5 = 0 THEN 'obscure' ELSE 'side' END AS reason FROM c),
x AS (SELECT c.*, b.reason, CASE WHEN a.v = 'KEEP' AND b.v = 'KEEP' THEN 'BOTH_KEEP' WHEN a.v = 'DROP' AND b.v = 'KEEP' THEN 'PRO_RESCUE' WHEN a.v = 'DROP' AND b.v = 'DROP' THEN 'BOTH_DROP' WHEN a.v = 'KEEP' AND b.v = 'DROP' THEN 'PRO_VETO' ELSE 'HAS_ERROR' END AS bucket FROM c LEFT JOIN a USING (cluster_id) LEFT JOIN b USING (cluster_id))"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.clusters(spark, sf_dir)
    first = c.where("cluster_id % 7 <> 0").selectExpr("cluster_id", "CASE WHEN cluster_id % 2 = 0 THEN 'keep' ELSE 'drop' END AS verdict", "'' AS reason")
    second = c.selectExpr("cluster_id", "CASE WHEN cluster_id % 3 = 0 THEN 'drop' ELSE 'keep' END AS verdict", "CASE WHEN cluster_id % 5 = 0 THEN 'obscure' ELSE 'side' END AS reason")
    return V.verdict_buckets(c, first, second)


@query("verdict_buckets", VERDICTS + " SELECT bucket, count(*) AS n, sum(total_count)::BIGINT AS rows, round(100 * count(*) / sum(count(*)) OVER (), 2) AS share FROM x GROUP BY bucket")
def verdict_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bucket_report(_buckets(spark, sf_dir))


@query("drop_policy", VERDICTS + " SELECT cluster_id, CASE WHEN cluster_id % 11 = 0 THEN false WHEN bucket = 'BOTH_DROP' THEN true WHEN bucket = 'PRO_VETO' THEN NOT (canonical_name LIKE '%deluxe%' OR (reason = 'obscure' AND total_count >= 3)) ELSE false END AS dropped FROM x")
def drop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.drop_policy(_buckets(spark, sf_dir), I.clusters(spark, sf_dir).where("cluster_id % 11 = 0"), ["deluxe"]).select("cluster_id", "dropped")


@query(
    "recanonicalize",
    A + f""", v AS (SELECT cluster_id, first(alias_name ORDER BY len(list_filter({words('alias_name')}, lambda t: length(t) = 1)) > 0, alias_count DESC, len({words('alias_name')}), length(alias_name), alias_name) AS voted FROM al WHERE method <> 'rescue_merge' GROUP BY 1) SELECT voted AS canonical_name, alias_name, alias_count, cluster_id, method FROM al JOIN v USING (cluster_id)""",
)
def recanonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recanonicalize(_aliases(spark, sf_dir))


@query("fuzzy_clusters")
def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fuzzy_clusters(cleaning.count_names(I.read(spark, sf_dir, "documents"), F.lower("text")))
