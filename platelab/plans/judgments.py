"""Queries over flags, verdicts, judgments and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.functions import text as T
from platelab.operators import cleaning, index, rules
from platelab.operators import vocabulary as V

from . import inputs as I
from .menus import PASSAGE_WORDS, passage_rules
from .registry import query

VERDICT = "CASE p_partkey % 4 WHEN 0 THEN 'Keep' WHEN 1 THEN 'drop' WHEN 2 THEN ' Review ' ELSE 'keep' END"
REASON = "CASE p_size % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'drink' ELSE 'ok' END"
NAMED = f"(SELECT concat(p_name, ' ', p_partkey) AS name, p_size AS n, trim({VERDICT}) AS verdict, {REASON} AS reason, p_partkey FROM part)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_partkey) AS name", "p_size AS n", f"trim({VERDICT}) AS verdict", f"{REASON} AS reason", "p_partkey")


@query("null_sentinel", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS price_range FROM part")
def null_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").withColumn("r", F.when(F.col("p_partkey") % 4 == 0, "$" * 17).otherwise(F.col("p_type")))
    return x.select("p_partkey", T.sentinel_to_null(F.col("r")).alias("price_range"))


@query("changed_tags", "SELECT count(*) AS rows, count(*) FILTER (WHERE s_suppkey % 5 IN (1, 3)) AS changed FROM supplier")
def changed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("Pizza", "Pizzas"), ("Thai", "Thai")], "spelling string, canonical string")
    return cleaning.changed_count(cleaning.remap_tags(I.restaurants(spark, sf_dir), "category", mapping, "id"))


@query("marked_values", "SELECT p_name AS value FROM part WHERE p_partkey % 3 = 0")
def marked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_name AS value", "CASE p_partkey % 6 WHEN 0 THEN ' X' WHEN 3 THEN 'x ' WHEN 1 THEN 'xx' END AS mark")
    return cleaning.marked(x, "value", "mark")


@query("name_summary", "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT count(*) AS names, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n = 1) AS singletons FROM c")
def name_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.count_summary(cleaning.count_names(I.read(spark, sf_dir, "part"), F.col("p_name")))


@query("count_distribution", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT list(n ORDER BY n) AS l FROM c) SELECT share, l[greatest(1, floor(len(l) * share)::BIGINT)] AS value FROM l, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]::DOUBLE[]) AS share)")
def count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.count_distribution(cleaning.count_names(I.read(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")))


@query(
    "count_buckets",
    "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 WHEN n BETWEEN 4 AND 5 THEN 3 WHEN n BETWEEN 6 AND 10 THEN 4 WHEN n BETWEEN 11 AND 20 THEN 5 WHEN n BETWEEN 21 AND 50 THEN 6 WHEN n BETWEEN 51 AND 100 THEN 7 WHEN n BETWEEN 101 AND 500 THEN 8 ELSE 9 END AS bucket, count(*) AS names, sum(n)::BIGINT AS rows FROM c GROUP BY 1",
)
def count_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.count_buckets(cleaning.count_names(I.read(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string")))


@query(
    "concentration",
    "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, sum(n) OVER () AS total, count(*) OVER () AS names FROM c) SELECT top, round((100 * sum(n) / max(total))::DOUBLE, 6) AS percent FROM r, (SELECT unnest([10, 100, 1000, 5000, 10000, 50000, 100000]) AS top) WHERE r <= top AND top <= names GROUP BY top",
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.concentration(cleaning.count_names(I.read(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string"))).withColumn("percent", F.round("percent", 6))


@query("apply_flags", "SELECT p_partkey, p_name FROM part WHERE p_size % 4 NOT IN (1, 2)")
def apply_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "CASE p_size % 4 WHEN 1 THEN ' X' WHEN 2 THEN '?' WHEN 3 THEN '' END AS flag")
    return cleaning.without_flagged(x).select("p_partkey", "p_name")


@query(
    "rule_cascade",
    f"""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-zà-ÿ0-9]+', ' ', 'g')), ' ') AS w FROM documents), p AS (SELECT place, w || ' ' || next AS two, w || '+' || next AS reason, CASE WHEN place // 1000 % 3 = 0 THEN 'review' ELSE 'drop' END AS verdict FROM {PASSAGE_WORDS} WHERE next IS NOT NULL),
h AS (SELECT doc_id, min(place) AS place FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS two FROM d) JOIN p USING (two) GROUP BY 1)
SELECT doc_id, coalesce(verdict, 'keep') AS verdict, coalesce(reason, 'default') AS reason FROM d LEFT JOIN h USING (doc_id) LEFT JOIN p USING (place)""",
)
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules from a table, over whole documents."""
    x = I.read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ0-9]+", " ")).alias("name"))
    return rules.judged(x, "doc_id", "name", passage_rules(spark, sf_dir)).select("doc_id", "verdict", "reason")


@query("kept_verdicts", f"SELECT name, n FROM {NAMED} WHERE lower(verdict) = 'keep'")
def kept_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(spark, sf_dir)
    return cleaning.merge_verdicts([x.where("p_partkey % 2 = 0").drop("p_partkey"), x.where("p_partkey % 2 = 1").drop("p_partkey")])[0].select("name", "n")


@query("verdict_counts", f"SELECT verdict, reason, count(*) AS names, sum(n)::BIGINT AS rows FROM {NAMED} GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.merge_verdicts([_named(spark, sf_dir).drop("p_partkey")])[1]


@query("restaurant_export", f"SELECT id, name, coalesce(category, '') AS category FROM {I.RESTAURANT_SQL} WHERE category IS NULL OR NOT regexp_matches(category, '(^|, ?)Grocery')")
def restaurant_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.exported(I.restaurants(spark, sf_dir), T.tags(F.col("category")), I.EXCLUDED_TAGS, "name")


@query("review_split", f"WITH r AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) - 1 AS k, count(*) OVER () AS c FROM {NAMED} WHERE lower(verdict) = 'review' AND p_partkey % 10 <> 6) SELECT name, (k // ((c + 2) // 3))::INT AS chunk FROM r")
def review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(spark, sf_dir)
    return cleaning.review_split(x, x.where("p_partkey % 10 = 6"), "name", "n").select("name", "chunk")


@query("synonym_notes", "SELECT lower(p_name) AS word, max(lower(p_type)) AS canonical FROM part WHERE p_partkey % 4 = 1 GROUP BY 1")
def synonym_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("upper(p_name) AS alias_token", "CASE p_partkey % 4 WHEN 2 THEN p_name ELSE p_type END AS canonical_token", "CASE WHEN p_partkey % 4 IN (1, 2) THEN ' APPLY: sure' WHEN p_partkey % 4 = 3 THEN 'maybe APPLY' END AS notes")
    return cleaning.applied_synonyms(x)


# Aliases: clusters of parts by brand and size.
ALIASES = "(SELECT min(p_name) OVER (PARTITION BY p_size) AS canonical_name, concat(p_name, ' ', p_partkey) AS alias_name, p_partkey % 17 AS alias_count, p_size::BIGINT AS cluster_id, CASE p_partkey % 3 WHEN 0 THEN 'self' ELSE 'fuzzy' END AS method FROM part)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    heads = p.groupBy("p_size").agg(F.min("p_name").alias("canonical_name"))
    return p.join(heads, "p_size").selectExpr("canonical_name", "concat(p_name, ' ', p_partkey) AS alias_name", "p_partkey % 17 AS alias_count", "CAST(p_size AS BIGINT) AS cluster_id", "CASE p_partkey % 3 WHEN 0 THEN 'self' ELSE 'fuzzy' END AS method")


@query(
    "one_self",
    f"WITH a AS {ALIASES}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY method = 'self' DESC, CASE WHEN method = 'self' THEN 0 ELSE -alias_count END, alias_name) AS r FROM a) SELECT cluster_id, alias_name, CASE WHEN r = 1 THEN 'self' ELSE 'fuzzy' END AS method FROM r",
)
def one_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.one_self(_aliases(spark, sf_dir)).select("cluster_id", "alias_name", "method")


@query("drop_audit", f"SELECT cluster_id % 6 = 1 AS gone, count(DISTINCT cluster_id) AS clusters, count(*) AS aliases, sum(alias_count)::BIGINT AS rows FROM {ALIASES} GROUP BY 1")
def drop_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aliases(spark, sf_dir)
    return V.drop_audit(a, a.where("cluster_id % 6 = 1"))


@query("reviewed_aliases", f"SELECT cluster_id, alias_name FROM {ALIASES} WHERE cluster_id % 6 <> 1 AND cluster_id % 7 <> 2")
def reviewed_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aliases(spark, sf_dir)
    of = lambda n, r: a.where(f"cluster_id % {n} = {r}").select("cluster_id", F.lit(" DROP").alias("verdict"))
    return V.reviewed(a, of(6, 1), of(7, 2), of(5, 0).withColumn("verdict", F.lit("keep"))).select("cluster_id", "alias_name")


@query("judge_batches", "WITH r AS (SELECT p_partkey, concat(p_name, ' -> ', p_type) AS line, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) SELECT (k // 20)::INT AS batch, string_agg(concat(k % 20 + 1, '. ', line), chr(10) ORDER BY k) AS prompt, count(*) AS items FROM r GROUP BY 1")
def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judge_batches(I.read(spark, sf_dir, "part"), [F.col("p_partkey")], F.concat_ws(" -> ", "p_name", "p_type"))


@query("judge_replies", "SELECT p_partkey AS batch, item, CASE WHEN item = 3 THEN 'PARSE_ERROR' WHEN item = 1 THEN 'YES' ELSE 'NO' END AS verdict, CASE item WHEN 1 THEN 'same ' || p_name WHEN 2 THEN '' END AS reason FROM part, (SELECT unnest([1, 2, 3]) AS item)")
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    replies = p.select(F.col("p_partkey").alias("batch"), F.concat(F.lit("Verdicts:\n1. yes - same "), F.col("p_name"), F.lit("\n2) No\n3 maybe")).alias("reply"))
    items = p.select(F.col("p_partkey").alias("batch"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("item"))
    return V.parse_replies(replies, items)


JUDGED = "(SELECT p_partkey AS source_id, p_partkey % 40 AS target_id, p_size AS target_count, CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'PARSE_ERROR' WHEN 3 THEN 'ERROR' END AS verdict FROM part)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read(spark, sf_dir, "part").selectExpr("p_partkey AS source_id", "p_partkey % 40 AS target_id", "p_size AS target_count", "CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'PARSE_ERROR' WHEN 3 THEN 'ERROR' END AS verdict")


@query("retried_rows", f"SELECT source_id, verdict FROM {JUDGED} WHERE verdict IN ('yes', 'NO')")
def retried_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.without_errors(_judged(spark, sf_dir)).select("source_id", "verdict")


@query("judged_decisions", f"SELECT source_id AS cluster_id, CASE WHEN verdict = 'yes' THEN 'merge' ELSE 'drop' END AS action, CASE WHEN verdict = 'yes' THEN target_id END AS target_id FROM {JUDGED} WHERE verdict IN ('yes', 'NO')")
def judged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verdicts_to_decisions(V.without_errors(_judged(spark, sf_dir))).select("cluster_id", "action", "target_id")


# Decisions about the clusters above: merge, rename and drop.
DECIDED = "CASE WHEN cluster_id % 5 = 0 THEN 'merge' WHEN cluster_id % 5 = 1 THEN 'rename' WHEN cluster_id % 5 = 2 THEN 'drop' END"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aliases(spark, sf_dir).select("cluster_id").distinct()
    return a.selectExpr("cluster_id", f"{DECIDED} AS action", "CASE WHEN cluster_id % 5 = 0 THEN cluster_id - 1 END AS target_id", "CASE WHEN cluster_id % 5 = 1 THEN concat('new ', cluster_id) END AS new_name").where("action IS NOT NULL AND cluster_id > 1")


def _applied(policy: str) -> str:
    own, head = "alias_name = canonical_name", "h.canonical_name"
    method = {"all_rows": "CASE WHEN cluster_id % 5 = 0 THEN 'm' ELSE method END", "tag_only": "method", "replace_self": f"CASE WHEN cluster_id % 5 = 0 AND {own} THEN 'm' ELSE method END", "preserve_self": f"CASE WHEN cluster_id % 5 = 0 AND {own} THEN 'm' WHEN cluster_id % 5 = 1 AND {own} THEN 'kept' ELSE method END"}[policy]
    alias = f"CASE WHEN cluster_id % 5 = 1 AND {own} THEN concat('new ', cluster_id) ELSE alias_name END" if policy == "replace_self" else "alias_name"
    more = f" UNION ALL SELECT concat('new ', cluster_id), concat('new ', cluster_id), 0, cluster_id, 'self' FROM a WHERE cluster_id > 1 AND cluster_id % 5 = 1 AND {own}" if policy == "preserve_self" else ""
    return f"""WITH a AS {SELVES}, h AS (SELECT cluster_id AS id, any_value(canonical_name) AS canonical_name FROM a GROUP BY 1)
SELECT CASE WHEN a.cluster_id > 1 AND a.cluster_id % 5 = 1 THEN concat('new ', cluster_id) WHEN a.cluster_id % 5 = 0 THEN {head} ELSE a.canonical_name END AS canonical_name, {alias.replace("canonical_name", "a.canonical_name").replace("cluster_id % 5 = 1", "cluster_id > 1 AND cluster_id % 5 = 1")} AS alias_name, alias_count, CASE WHEN cluster_id % 5 = 0 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id, {method.replace("canonical_name", "a.canonical_name").replace("cluster_id % 5 = 1", "cluster_id > 1 AND cluster_id % 5 = 1")} AS method
FROM a LEFT JOIN h ON h.id = a.cluster_id - 1 WHERE a.cluster_id % 5 <> 2{more}"""


SELVES = "(SELECT min(p_name) OVER (PARTITION BY p_size) AS canonical_name, CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 THEN min(p_name) OVER (PARTITION BY p_size) ELSE concat(p_name, ' ', p_partkey) END AS alias_name, p_partkey % 17 AS alias_count, p_size::BIGINT AS cluster_id, CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 THEN 'self' ELSE 'fuzzy' END AS method FROM part)"


def _selves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.read(spark, sf_dir, "part")
    heads = p.groupBy("p_size").agg(F.min("p_name").alias("canonical_name"), F.min("p_partkey").alias("first"))
    own = F.col("p_partkey") == F.col("first")
    return p.join(heads, "p_size").select("canonical_name", F.when(own, F.col("canonical_name")).otherwise(F.concat_ws(" ", "p_name", "p_partkey")).alias("alias_name"), (F.col("p_partkey") % 17).alias("alias_count"), F.col("p_size").cast("long").alias("cluster_id"), F.when(own, "self").otherwise("fuzzy").alias("method"))


def _register(policy: str) -> None:
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.apply_decisions(_selves(spark, sf_dir), _decisions(spark, sf_dir), policy, "m", "kept")

    query(f"decisions_{policy}", _applied(policy))(apply)


for _policy in ("replace_self", "preserve_self", "all_rows", "tag_only"):
    _register(_policy)


PROPOSALS = """(SELECT p_partkey AS source_cid, CASE p_partkey % 6 WHEN 0 THEN 'Merge' WHEN 1 THEN 'merge ' WHEN 2 THEN 'rename' WHEN 3 THEN 'RENAME' WHEN 4 THEN 'explode' ELSE 'merge' END AS action, CASE WHEN p_partkey % 6 = 5 THEN p_partkey ELSE p_partkey + 7 END AS target_cid,
 CASE WHEN p_partkey % 6 = 2 THEN concat(p_name, ' new') WHEN p_partkey % 6 = 3 THEN ' ' END AS new_canonical, CASE p_size % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'med' WHEN 2 THEN 'x' END AS confidence, p_size AS priority FROM part)"""
ISSUE = "CASE WHEN trim(lower(action)) NOT IN ('merge', 'rename') THEN 'unknown action' WHEN trim(lower(action)) = 'merge' AND target_cid > (SELECT max(p_partkey) FROM part) THEN 'no such target' WHEN trim(lower(action)) = 'merge' AND source_cid = target_cid THEN 'merges with itself' WHEN trim(lower(action)) = 'rename' AND trim(coalesce(new_canonical, '')) = '' THEN 'no new name' END"


def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = I.read(spark, sf_dir, "part")
    rows = p.selectExpr(
        "p_partkey AS source_cid", "CASE p_partkey % 6 WHEN 0 THEN 'Merge' WHEN 1 THEN 'merge ' WHEN 2 THEN 'rename' WHEN 3 THEN 'RENAME' WHEN 4 THEN 'explode' ELSE 'merge' END AS action", "CASE WHEN p_partkey % 6 = 5 THEN p_partkey ELSE p_partkey + 7 END AS target_cid",
        "CASE WHEN p_partkey % 6 = 2 THEN concat(p_name, ' new') WHEN p_partkey % 6 = 3 THEN ' ' END AS new_canonical", "CASE p_size % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'med' WHEN 2 THEN 'x' END AS confidence", "p_size AS priority",
    )
    clusters = p.selectExpr("p_partkey AS cluster_id", "CASE WHEN p_partkey = 3 THEN (SELECT 'none') ELSE concat(p_name, ' ', p_partkey) END AS canonical_name")
    return (*V.validate_proposals(rows, clusters), clusters)


@query("valid_proposals", f"SELECT source_cid, trim(lower(action)) AS action, CASE p_c WHEN 'High' THEN 'high' WHEN 'med' THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT *, confidence AS p_c, {ISSUE} AS issue FROM {PROPOSALS}) WHERE issue IS NULL")
def valid_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir)[0].select("source_cid", "action", "bucket")


@query("proposal_issues", f"SELECT source_cid, issue FROM (SELECT *, {ISSUE} AS issue FROM {PROPOSALS}) WHERE issue IS NOT NULL")
def proposal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir)[1].select("source_cid", "issue")


@query("resolved_proposals", f"SELECT source_cid AS cluster_id, trim(lower(action)) AS action, target_cid AS target_id, CASE WHEN trim(lower(action)) = 'rename' THEN new_canonical END AS new_name FROM (SELECT *, {ISSUE} AS issue FROM {PROPOSALS}) WHERE issue IS NULL")
def resolved_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _, clusters = _proposals(spark, sf_dir)
    return V.resolve_proposals(good, clusters)


@query("decision_overlay", "SELECT p_partkey AS cluster_id, CASE WHEN p_partkey % 3 = 0 THEN 'drop' ELSE 'merge' END AS action FROM part WHERE p_partkey % 4 <> 1 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)")
def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda where, action: I.read(spark, sf_dir, "part").where(where).select(F.col("p_partkey").alias("cluster_id"), F.lit(action).alias("action"), F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("string").alias("new_name"))
    return V.overlay(of("p_partkey % 2 = 0", "merge"), of("p_partkey % 3 = 0", "drop"), of("p_partkey % 4 = 1", "keep")).select("cluster_id", "action")


@query(
    "bucket_examples",
    "WITH b AS (SELECT concat(p_name, ' ', p_partkey) AS canonical_name, p_size AS total_count, p_type AS bucket, p_brand AS second_reason FROM part), t AS (SELECT bucket, 'top' AS kind, NULL AS reason, row_number() OVER (PARTITION BY bucket ORDER BY total_count DESC, canonical_name) AS rank, canonical_name FROM b), s AS (SELECT bucket, 'sample' AS kind, second_reason AS reason, row_number() OVER (PARTITION BY bucket, second_reason ORDER BY md5(canonical_name), canonical_name) AS rank, canonical_name FROM b) SELECT bucket, kind, reason, rank::INT AS rank, canonical_name FROM t WHERE rank <= 3 UNION ALL SELECT bucket, kind, reason, rank::INT, canonical_name FROM s WHERE rank <= 2",
)
def bucket_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bucket_examples(I.read(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_partkey) AS canonical_name", "p_size AS total_count", "p_type AS bucket", "p_brand AS second_reason"))


@query(
    "review_records",
    f"WITH a AS {ALIASES}, t AS (SELECT cluster_id, any_value(canonical_name) AS canonical_name, sum(alias_count)::BIGINT AS total_count, list(alias_name ORDER BY alias_count DESC, alias_name)[:3] AS forms FROM a GROUP BY 1), m AS (SELECT p_size::BIGINT AS id, list(DISTINCT p_partkey % 9) AS l FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT cluster_id, canonical_name, total_count, array_to_string(forms, '|') AS forms, CASE WHEN l IS NULL THEN '' ELSE array_to_string(list_sort(l), ',') END AS suggestions FROM t LEFT JOIN m ON id = cluster_id",
)
def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = I.read(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_size").cast("long").alias("source_id"), (F.col("p_partkey") % 9).alias("target_id"), F.lit(0.8).alias("ratio")).distinct()
    x = V.review_records(_aliases(spark, sf_dir), merges)
    return x.select("cluster_id", "canonical_name", "total_count", F.array_join("forms", "|").alias("forms"), F.array_join(F.transform("suggestions", lambda i: i.cast("string")), ",").alias("suggestions"))


@query("traced_names", f"SELECT name, category, count(*) AS n FROM {I.MENU_SQL} WHERE name = 'ten hot ring tenders' AND category IS DISTINCT FROM 'Wraps' AND category IS DISTINCT FROM 'Noodles' GROUP BY ALL")
def traced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.trace(I.menus(spark, sf_dir), "hot ring tenders", I.SYNONYMS)
