"""The alias vocabulary: candidates, decisions and their application.

An alias table has canonical_name, alias_name, alias_count, cluster_id and method. Every layer of cleaning makes a
decision frame (cluster_id, action, target_id, new_name) and applies it with one operator; the summary by cluster is
always derived.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.functions import text as T
from platelab.session import checkpointed

COLUMNS = ["canonical_name", "alias_name", "alias_count", "cluster_id", "method"]


def summary(aliases: DataFrame) -> DataFrame:
    """cluster_id, canonical_name, n_aliases and total_count."""
    return aliases.groupBy("cluster_id").agg(F.max("canonical_name").alias("canonical_name"), F.count("*").alias("n_aliases"), F.sum("alias_count").alias("total_count"))


def drop_clusters(aliases: DataFrame, dropped: DataFrame) -> DataFrame:
    """Aliases of clusters that ``dropped`` (cluster_id) does not name."""
    return aliases.join(dropped.select("cluster_id").distinct(), "cluster_id", "left_anti")


def reviewed(aliases: DataFrame, *verdicts: DataFrame) -> DataFrame:
    """Drop the clusters that any of the reviews (cluster_id, verdict) drops."""
    every = verdicts[0]
    for v in verdicts[1:]:
        every = every.unionByName(v)
    return drop_clusters(aliases, every.where(F.lower(F.trim("verdict")) == "drop"))


def token_hits(clusters: DataFrame, words: Iterable[str]) -> DataFrame:
    """Clusters whose name has one of the words; reason is the first of them in order."""
    hits = F.array_intersect(T.tokens(F.col("canonical_name")), T.literal_array(sorted(words)))
    return clusters.withColumn("reason", F.array_min(hits)).where("reason is not null")


def bare_formats(clusters: DataFrame, words: Iterable[str], most: int = 2) -> DataFrame:
    """Clusters of at most ``most`` words, all of which name a format."""
    tokens = T.tokens(F.col("canonical_name"))
    known = T.literal_array(sorted(words))
    return clusters.where((F.size(tokens).between(1, most)) & F.forall(tokens, lambda t: F.array_contains(known, t)))


def without_single_letters(name: Column) -> Column:
    return T.joined(F.filter(T.tokens(name), lambda t: ~t.rlike("^[a-z]$")))


def without_words(name: Column, words: Iterable[str]) -> Column:
    gone = T.literal_array(sorted(words))
    return T.joined(F.filter(T.tokens(name), lambda t: ~F.array_contains(gone, t)))


def without_doubles(name: Column, preserved: Iterable[str]) -> Column:
    """Each word once, but for the preserved ones; sorted."""
    tokens, kept = T.tokens(name), T.literal_array(sorted(preserved))
    return T.joined(F.array_sort(F.filter(tokens, lambda t, i: F.array_contains(kept, t) | (F.array_position(tokens, t) == i + 1))))


def cleaned_decisions(clusters: DataFrame, cleaned: Column, least_tokens: int = 2) -> DataFrame:
    """Decisions for clusters whose name changes: merge into the cluster of that name, else rename if enough words are
    left, else drop."""
    changed = clusters.select("cluster_id", "canonical_name", cleaned.alias("new_name")).where("new_name <> canonical_name")
    there = clusters.groupBy(F.col("canonical_name").alias("new_name")).agg(F.min("cluster_id").alias("target_id"))
    found = changed.join(there, "new_name", "left")
    action = F.when(F.col("target_id").isNotNull(), "merge").when(F.size(T.tokens(F.col("new_name"))) >= least_tokens, "rename").otherwise("drop")
    return found.select("cluster_id", "canonical_name", action.alias("action"), "target_id", F.when(action == "rename", F.col("new_name")).alias("new_name"))


def apply_decisions(aliases: DataFrame, decisions: DataFrame, policy: str, merge_method: str, rename_method: str = "rename_preserved") -> DataFrame:
    """Drop, merge and rename clusters.

    Policies: ``replace_self`` renames the self alias itself and marks the merged self alias; ``preserve_self`` keeps
    the old name as a further alias; ``all_rows`` marks every merged alias; ``tag_only`` changes ids and names alone.
    A merge follows its target one step further if that target merges too.
    """
    names = aliases.groupBy(F.col("cluster_id").alias("target_id")).agg(F.max("canonical_name").alias("target_name"))
    d = decisions.select("cluster_id", "action", "target_id", "new_name")
    onward = d.where("action = 'merge'").select(F.col("cluster_id").alias("target_id"), F.col("target_id").alias("next_id"))
    d = d.join(onward, "target_id", "left").where("action <> 'merge' or next_id is null or next_id <> cluster_id")
    d = d.withColumn("target_id", F.coalesce("next_id", "target_id")).drop("next_id").join(names, "target_id", "left")
    renamed = d.where("action = 'rename'").select(F.col("cluster_id").alias("target_id"), F.col("new_name").alias("renamed"))
    d = d.join(renamed, "target_id", "left").withColumn("target_name", F.coalesce("renamed", "target_name")).drop("renamed")
    x = aliases.join(d, "cluster_id", "left").where("action is null or action <> 'drop'")
    merge, rename = F.coalesce(F.col("action") == "merge", F.lit(False)), F.coalesce(F.col("action") == "rename", F.lit(False))
    own = F.col("alias_name") == F.col("canonical_name")
    row = lambda canonical, alias, count, method: F.struct(canonical.alias("canonical_name"), alias.alias("alias_name"), count.alias("alias_count"), F.when(merge, F.col("target_id")).otherwise(F.col("cluster_id")).alias("cluster_id"), method.alias("method"))
    canonical = F.when(merge, F.col("target_name")).when(rename, F.col("new_name")).otherwise(F.col("canonical_name"))
    if policy == "replace_self":
        method, alias = F.when(merge & own, F.lit(merge_method)).otherwise(F.col("method")), F.when(rename & own, F.col("new_name")).otherwise(F.col("alias_name"))
    elif policy == "all_rows":
        method, alias = F.when(merge, F.lit(merge_method)).otherwise(F.col("method")), F.col("alias_name")
    else:
        method, alias = F.when(merge & own & F.lit(policy == "preserve_self"), F.lit(merge_method)).otherwise(F.col("method")), F.col("alias_name")
    plain = row(canonical, alias, F.col("alias_count"), method)
    if policy == "preserve_self":
        both = F.array(row(canonical, F.col("new_name"), F.lit(0).cast("long"), F.lit("self")), row(canonical, F.col("alias_name"), F.col("alias_count"), F.lit(rename_method)))
        rows = F.when(rename & own, both).otherwise(F.array(plain))
    else:
        rows = F.array(plain)
    return x.select(F.explode(rows).alias("r")).select("r.*").select(*COLUMNS)


def one_self(aliases: DataFrame) -> DataFrame:
    """Exactly one alias per cluster with method self: the first if there are more, the most frequent if there is none."""
    w = Window.partitionBy("cluster_id")
    is_self = (F.col("method") == "self").cast("int")
    order = w.orderBy(F.desc("is_self"), F.when(F.col("is_self") == 1, 0).otherwise(-F.col("alias_count")), "alias_name")
    ranked = aliases.withColumn("is_self", is_self).withColumn("r", F.row_number().over(order))
    method = F.when(F.col("r") == 1, "self").when(F.col("is_self") == 1, "fuzzy").otherwise(F.col("method"))
    return ranked.withColumn("method", method).select(*COLUMNS)


def synonym_merge(aliases: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Merge clusters whose names agree once synonyms are replaced; the largest gives its id and rewritten name."""
    key = T.joined(F.array_sort(F.array_distinct(T.replaced(T.tokens(F.col("canonical_name")), synonyms))))
    keyed = summary(aliases).withColumn("key", key)
    heads = keyed.groupBy("key").agg(F.min_by("cluster_id", F.struct(-F.col("total_count"), F.substring("canonical_name", 1, 1), F.col("cluster_id"))).alias("head"))
    to = keyed.join(heads, "key").select("cluster_id", "head", "key")
    x = aliases.join(to, "cluster_id")
    method = F.when((F.col("head") != F.col("cluster_id")) | (F.col("key") != F.col("canonical_name")), "synonym").otherwise(F.col("method"))
    return x.select(F.col("key").alias("canonical_name"), "alias_name", "alias_count", F.col("head").alias("cluster_id"), method.alias("method"))


def synonym_impact(clusters: DataFrame, synonyms: dict[str, str], examples: int = 5) -> DataFrame:
    """Per synonym: clusters, rows and the most frequent names it rewrites."""
    spark = clusters.sparkSession
    table = spark.createDataFrame(sorted(synonyms.items()), "word string, canonical string")
    hit = clusters.select("cluster_id", "canonical_name", "total_count", F.explode(F.array_distinct(T.tokens(F.col("canonical_name")))).alias("word"))
    lists = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("total_count")).alias("minus"), "canonical_name"))), 1, examples)
    return hit.join(F.broadcast(table), "word").groupBy("word", "canonical").agg(F.count("*").alias("clusters"), F.sum("total_count").alias("rows"), F.transform(lists, lambda x: x["canonical_name"]).alias("examples"))


def ingredient_flags(clusters: DataFrame, bare: Iterable[str], kept: Iterable[str], pairs: Iterable[str]) -> DataFrame:
    """verdict and reason: bare ingredients, fragments and number variants of other names are dropped."""
    name, tokens = F.col("canonical_name"), T.tokens(F.col("canonical_name"))
    x = clusters.withColumn("stripped", T.strip_number_tokens(name))
    there = clusters.select(F.col("canonical_name").alias("other")).distinct()
    x = x.join(there, x["stripped"] == there["other"], "left")
    one = (F.size(tokens) == 1) & ~name.isin(*kept)
    digit = name.rlike("[0-9]")
    left = F.size(T.tokens(F.col("stripped")))
    redundant = digit & F.col("other").isNotNull() & (F.col("stripped") != name)
    fragment = digit & F.col("stripped").isNotNull() & (left <= 1)
    reason = (
        F.when(one & name.isin(*bare), F.concat(F.lit("bare_ingredient_1tok ("), name, F.lit(")")))
        .when(one, "single_token_not_listed")
        .when(name.isin(*pairs), "bare_ingredient_2tok")
        .when(F.get(tokens, F.lit(0)) == "by", "by_prefix_fragment")
        .when(redundant, F.concat(F.lit("redundant_with: "), F.col("stripped")))
        .when(fragment, "fragment_after_number_strip")
        .when(digit, "has_digit_no_match")
        .otherwise("ok")
    )
    verdict = F.when(reason.isin("single_token_not_listed", "has_digit_no_match"), "review").when(reason == "ok", "keep").otherwise("drop")
    return x.withColumn("reason", reason).withColumn("verdict", verdict).drop("stripped", "other")


def long_singletons(clusters: DataFrame, allowed: Iterable[str], least: int = 5) -> DataFrame:
    """Clusters seen once, of many words, none of which is allowed."""
    tokens = T.tokens(F.col("canonical_name"))
    return clusters.where((F.col("total_count") == 1) & (F.size(tokens) >= least) & ~F.arrays_overlap(tokens, T.literal_array(sorted(allowed))))


def _rarity(*tables: DataFrame) -> DataFrame:
    """How many names of the tables (words) have each word."""
    every = tables[0].select("words")
    for t in tables[1:]:
        every = every.union(t.select("words"))
    return every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("names"))


def _rarest(rows: DataFrame, rarity: DataFrame, key: str, least: Column) -> DataFrame:
    """The ``least`` rarest words of each row (key, words): (key, word)."""
    each = rows.select(key, least.alias("least"), F.explode("words").alias("word")).join(rarity, "word")
    ranked = each.groupBy(key).agg(F.max("least").alias("least"), F.array_sort(F.collect_list(F.struct("names", "word"))).alias("w"))
    return ranked.select(key, F.explode(F.slice("w", F.lit(1), F.col("least").cast("int"))).alias("x")).select(key, "x.word")


def merge_candidates(clusters: DataFrame, target_least: int = 5, source_most: int = 1, overlap: float = 0.6, growth: int = 2, top: int = 3, sizes: tuple[int, int] = (2, 6)) -> DataFrame:
    """Rare names with the frequent names that share most of their words, through an index of words.

    A name that shares at least ``overlap`` of a source's words shares one of its rarest words, of which there are as
    many as it may miss and one more. So frequent words are looked up for names only that have no rare ones.
    """
    words = clusters.withColumn("words", F.array_distinct(T.tokens(F.col("canonical_name")))).withColumn("size", F.size("words"))
    s = words.where((F.col("total_count") <= source_most) & F.col("size").between(*sizes)).select(F.col("cluster_id").alias("source_id"), F.col("words"), F.col("size").alias("source_size"))
    t = words.where(F.col("total_count") >= target_least).select(F.col("cluster_id").alias("target_id"), F.col("total_count").alias("target_count"), F.col("size").alias("target_size"), F.col("words"))
    need = F.ceil(F.col("source_size") * overlap - 1e-9)
    probes = _rarest(s, _rarity(t, s), "source_id", F.col("source_size") - need + 1)
    met = probes.join(t.select("target_id", F.explode("words").alias("word")), "word").select("source_id", "target_id").distinct()
    pairs = met.join(s, "source_id").join(t.withColumnRenamed("words", "target_words"), "target_id").where(f"source_id <> target_id and target_size <= {growth} * source_size")
    shared = pairs.withColumn("shared", F.size(F.array_intersect("words", "target_words")).cast("long")).where("shared > 0")
    ratio = F.col("shared") / F.col("source_size")
    w = Window.partitionBy("source_id").orderBy(F.desc("ratio"), F.desc("target_count"), "target_id")
    return shared.withColumn("ratio", ratio).where(F.col("ratio") >= overlap).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("source_id", "target_id", "target_count", "shared", "ratio")


def rescue_candidates(dropped: DataFrame, kept: DataFrame, blocked: Iterable[str], dropped_least: int = 5, kept_least: int = 20, noise: tuple[int, int] = (1, 2), top: int = 3) -> DataFrame:
    """Dropped names that hold all words of a frequent kept name and one or two more; found by its rarest word."""
    words = lambda x, least: x.where(F.col("total_count") >= least).withColumn("words", F.array_distinct(T.tokens(F.col("canonical_name")))).withColumn("size", F.size("words")).where("size > 0")
    d = words(dropped, dropped_least).select(F.col("cluster_id").alias("dropped_id"), F.col("size").alias("dropped_size"), "words")
    k = words(kept, kept_least).where(~F.arrays_overlap("words", T.literal_array(sorted(blocked))))
    k = k.select(F.col("cluster_id").alias("target_id"), F.col("total_count").alias("target_count"), F.col("size").alias("target_size"), "words")
    probes = _rarest(k, _rarity(d, k), "target_id", F.lit(1))
    met = probes.join(d.select("dropped_id", F.explode("words").alias("word")), "word").join(d.withColumnRenamed("words", "dropped_words"), "dropped_id").join(k, "target_id")
    held = met.where(F.size(F.array_except("words", "dropped_words")) == 0).withColumn("noise", F.col("dropped_size") - F.col("target_size")).where(F.col("noise").between(*noise))
    w = Window.partitionBy("dropped_id").orderBy("noise", F.desc("target_count"), "target_id")
    return held.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("dropped_id", "target_id", "noise", "target_count")


def skeleton_pairs(clusters: DataFrame, words: Iterable[str] = ("sandwich", "sandwiches", "sub", "subs")) -> DataFrame:
    """Names that agree without the given words, paired with the most frequent of their group."""
    tokens, known = T.tokens(F.col("canonical_name")), T.literal_array(sorted(words))
    x = clusters.withColumn("skeleton", T.joined(F.filter(tokens, lambda t: ~F.array_contains(known, t)))).withColumn("hit", F.arrays_overlap(tokens, known)).where("skeleton <> ''")
    w = Window.partitionBy("skeleton")
    first = F.first(F.struct("cluster_id", "canonical_name")).over(w.orderBy(F.desc("total_count"), "cluster_id"))
    x = x.withColumn("n", F.count("*").over(w)).withColumn("any_hit", F.max("hit").over(w)).withColumn("head", first)
    return x.where("n >= 2 and any_hit and head.cluster_id <> cluster_id").select(F.col("cluster_id").alias("source_id"), F.col("head.cluster_id").alias("target_id"), "skeleton")


def judged_merges(judgments: DataFrame) -> DataFrame:
    """Decisions from pair judgments (source_id, target_id, target_count, verdict): the most frequent target of a yes."""
    yes = judgments.where(F.upper(F.trim("verdict")) == "YES")
    best = yes.groupBy(F.col("source_id").alias("cluster_id")).agg(F.min_by("target_id", F.struct(-F.col("target_count"), F.col("target_id"))).alias("target_id"))
    return best.select("cluster_id", F.lit("merge").alias("action"), "target_id", F.lit(None).cast("string").alias("new_name"))


def parse_replies(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Numbered verdict lines of replies (batch, reply) to items (batch, item); missing ones are PARSE_ERROR."""
    pattern = "(?im)^[ \\t]*(\\d+)[.):][ \\t]*(YES|NO|KEEP|DROP)\\b[ \\t:,-]*(.*)$"
    group = lambda k: F.regexp_extract_all("reply", F.lit(pattern), F.lit(k))
    lines = batches.select("batch", F.explode(F.arrays_zip(group(1).alias("item"), group(2).alias("verdict"), group(3).alias("reason"))).alias("x"))
    parsed = lines.select("batch", F.col("x.item").cast("int").alias("item"), F.upper("x.verdict").alias("verdict"), F.trim("x.reason").alias("reason")).dropDuplicates(["batch", "item"])
    return items.join(parsed, ["batch", "item"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("PARSE_ERROR")))


def without_errors(judged: DataFrame) -> DataFrame:
    """Judgments but for those to be asked again."""
    return judged.where(~F.coalesce(F.col("verdict"), F.lit("PARSE_ERROR")).isin("PARSE_ERROR", "ERROR"))


def verdict_buckets(clusters: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Clusters with two screens' verdicts and what they say together; missing verdicts count as errors."""
    x = clusters.join(first.select("cluster_id", F.upper("verdict").alias("first_verdict"), F.col("reason").alias("first_reason")), "cluster_id", "left")
    x = x.join(second.select("cluster_id", F.upper("verdict").alias("second_verdict"), F.col("reason").alias("second_reason")), "cluster_id", "left")
    a, b = F.col("first_verdict"), F.col("second_verdict")
    bucket = F.when((a == "KEEP") & (b == "KEEP"), "BOTH_KEEP").when((a == "DROP") & (b == "KEEP"), "PRO_RESCUE").when((a == "DROP") & (b == "DROP"), "BOTH_DROP").when((a == "KEEP") & (b == "DROP"), "PRO_VETO").otherwise("HAS_ERROR")
    return x.withColumn("bucket", bucket)


def bucket_report(buckets: DataFrame) -> DataFrame:
    """Clusters, their share and rows by bucket."""
    every = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("total_count").alias("rows"))
    return every.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def drop_policy(buckets: DataFrame, rescued: DataFrame, chains: Iterable[str], vague: Iterable[str] = ("obscure", "unknown", "unrecognized"), least: int = 3) -> DataFrame:
    """``dropped``: both screens, or the second alone unless a chain is named or it only did not know a frequent name."""
    r = rescued.select("cluster_id").distinct().withColumn("rescued", F.lit(True))
    chain = T.contains_any(F.col("canonical_name"), sorted(chains))
    spare = chain | (F.lower("second_reason").isin(*vague) & (F.col("total_count") >= least))
    gone = F.when(F.col("rescued"), False).when(F.col("bucket") == "BOTH_DROP", True).when(F.col("bucket") == "PRO_VETO", ~F.coalesce(spare, F.lit(False))).otherwise(False)
    return buckets.join(r, "cluster_id", "left").withColumn("dropped", gone).drop("rescued")


def overlay(*layers: DataFrame) -> DataFrame:
    """Decisions of all layers; later ones replace earlier ones, and keep cancels."""
    every = None
    for k, layer in enumerate(layers):
        one = layer.select("cluster_id", "action", "target_id", "new_name").withColumn("layer", F.lit(k))
        every = one if every is None else every.unionByName(one)
    last = every.groupBy("cluster_id").agg(F.max_by(F.struct("action", "target_id", "new_name"), "layer").alias("d"))
    return last.select("cluster_id", "d.*").where("action <> 'keep'")


def verdicts_to_decisions(judged: DataFrame) -> DataFrame:
    """YES merges into the target, anything else drops."""
    yes = F.upper("verdict") == "YES"
    return judged.select(F.col("source_id").alias("cluster_id"), F.when(yes, "merge").otherwise("drop").alias("action"), F.when(yes, F.col("target_id")).alias("target_id"), F.lit(None).cast("string").alias("new_name"))


def recanonicalize(aliases: DataFrame, without_vote: str = "rescue_merge") -> DataFrame:
    """Clusters renamed by their aliases: no one-letter word, then frequent, few words, short, first in order."""
    tokens = T.tokens(F.col("alias_name"))
    letter = F.exists(tokens, lambda t: F.length(t) == 1)
    order = F.struct(letter, -F.col("alias_count"), F.size(tokens), F.length("alias_name"), F.col("alias_name"))
    voted = aliases.where(F.col("method") != without_vote).groupBy("cluster_id").agg(F.min_by("alias_name", order).alias("voted"))
    return aliases.join(voted, "cluster_id", "left").withColumn("canonical_name", F.coalesce("voted", "canonical_name")).select(*COLUMNS)


def validate_proposals(proposals: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals (source_cid, action, target_cid, new_canonical, confidence, priority) that can be applied, with a
    bucket of confidence, and the others with what is wrong."""
    ids = clusters.select(F.col("cluster_id").alias("id")).distinct()
    x = proposals.join(ids.withColumnRenamed("id", "s"), proposals["source_cid"] == F.col("s"), "left").join(ids.withColumnRenamed("id", "t"), proposals["target_cid"] == F.col("t"), "left")
    action = F.lower(F.trim("action"))
    issue = (
        F.when(~action.isin("merge", "rename"), "unknown action")
        .when(F.col("s").isNull(), "no such source")
        .when((action == "merge") & F.col("t").isNull(), "no such target")
        .when((action == "merge") & (F.col("source_cid") == F.col("target_cid")), "merges with itself")
        .when((action == "rename") & (F.coalesce(F.trim("new_canonical"), F.lit("")) == ""), "no new name")
    )
    x = x.withColumn("issue", issue).withColumn("action", action).drop("s", "t")
    w = Window.partitionBy("source_cid", F.col("issue").isNull()).orderBy("priority")
    x = x.withColumn("issue", F.when(F.col("issue").isNull() & (F.row_number().over(w) > 1), "source named before").otherwise(F.col("issue")))
    sure = F.when(F.lower(F.trim("confidence")).isin("high", "h", "sure"), "high").when(F.lower(F.trim("confidence")).isin("medium", "med", "m"), "medium").otherwise("low")
    return x.where("issue is null").drop("issue").withColumn("bucket", sure), x.where("issue is not null")


def resolve_proposals(proposals: DataFrame, clusters: DataFrame) -> DataFrame:
    """Decisions from valid proposals: a rename onto a name that exists becomes a merge; merges that would end where
    they began are left out. ``apply_decisions`` follows one step further."""
    there = clusters.groupBy(F.col("canonical_name").alias("new_canonical")).agg(F.min("cluster_id").alias("same"))
    x = proposals.join(there, "new_canonical", "left")
    collides = (F.col("action") == "rename") & F.col("same").isNotNull() & (F.col("same") != F.col("source_cid"))
    d = x.select(F.col("source_cid").alias("cluster_id"), F.when(collides, "merge").otherwise(F.col("action")).alias("action"), F.when(collides, F.col("same")).otherwise(F.col("target_cid")).alias("target_id"), F.when(~collides & (F.col("action") == "rename"), F.col("new_canonical")).alias("new_name"))
    back = d.where("action = 'merge'").select(F.col("cluster_id").alias("a"), F.col("target_id").alias("b"))
    return d.join(back, (d["target_id"] == back["a"]) & (d["cluster_id"] == back["b"]) & (d["cluster_id"] > d["target_id"]), "left_anti")


def indel_ratio(a: str, b: str) -> float:
    """100 less the share of characters that insertions and deletions change."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for ch in b:  # bit-parallel longest common subsequence: zeros of the state are matched places
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / (len(a) + len(b))


#: Names in a tile; bins of the letters that a name is made of.
TILE, BINS = 1024, 64


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and how many letters of each bin every name has."""
    lengths = np.array([len(x) for x in names], np.int32)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4") % BINS
    at = np.repeat(np.arange(len(names)), lengths) * BINS + codes
    counts = np.bincount(at, minlength=len(names) * BINS).reshape(-1, BINS)
    return lengths, counts.astype(np.int16 if lengths.max(initial=0) < 1 << 15 else np.int32)


def _short_ratios(a: list[str], b: list[str], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``indel_ratio`` of pairs of names of at most 64 letters, all at once: one word of bits for each pair. Names that no
    pair has may be longer."""
    (of_a, p), (of_b, q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    a, b = [a[i] for i in of_a.tolist()], [b[i] for i in of_b.tolist()]
    letters = {ch: k for k, ch in enumerate(sorted(set("".join(a))))}
    masks = np.zeros((len(a), len(letters) + 1), np.uint64)
    for i, name in enumerate(a):
        for j, ch in enumerate(name):
            masks[i, letters[ch]] |= np.uint64(1 << j)
    codes = np.full((len(b), 64), len(letters))
    for i, name in enumerate(b):
        codes[i, : len(name)] = [letters.get(ch, len(letters)) for ch in name]
    state = np.full(len(p), np.uint64(2**64 - 1))
    la, lb = np.array([len(x) for x in a])[p], np.array([len(x) for x in b])[q]
    for j in range(int(lb.max(initial=0))):
        hit = state & masks[p, codes[q, j]]
        state = (state + hit) | (state - hit)
    used = np.uint64(2**64 - 1) >> (64 - la).astype(np.uint64)
    return 200.0 * np.bitwise_count(~state & used) / (la + lb)


def _tile_pairs(a: list[str], b: list[str] | None, ratio: float) -> Iterator[tuple[int, int, float]]:
    """Places and ratio of similar names: a bound from lengths and letters first, the common subsequence then."""
    la, ca = _letters(a)
    lb, cb = (la, ca) if b is None else _letters(b)
    other = a if b is None else b
    for top in range(0, len(a), 16):
        most = np.zeros((len(ca[top : top + 16]), len(other)), np.int32)
        for bin_ in range(0, BINS, 8):
            most += np.minimum(ca[top : top + 16, None, bin_ : bin_ + 8], cb[None, :, bin_ : bin_ + 8]).sum(axis=2, dtype=np.int32)
        p, q = np.nonzero(200.0 * most >= ratio * (la[top : top + 16, None] + lb[None]))
        p += top
        if b is None:
            p, q = p[p < q], q[p < q]
        short = (la[p] <= 64) & (lb[q] <= 64)
        if short.any():
            found = _short_ratios(a[top : top + 16], other, p[short] - top, q[short])
            yield from ((int(i), int(j), float(r)) for i, j, r in zip(p[short], q[short], found, strict=True) if r >= ratio)
        for i, j in zip(p[~short].tolist(), q[~short].tolist(), strict=True):
            if (r := indel_ratio(a[i], other[j])) >= ratio:
                yield i, j, r


def similar_pairs(names: DataFrame, ratio: float) -> DataFrame:
    """Names (uid, name, k) to pairs (v, u, ratio) of equal k, v < u, whose ``indel_ratio`` is at least ``ratio``.

    Names are dealt into tiles by k and by length, in steps of the greatest factor that the ratio allows; a tile meets
    the tiles of its own step and the next. Tiles are of bounded size, so a k that many names share is many tasks.
    """
    step = F.floor(F.log(F.length("name").cast("double")) / float(np.log((200 - ratio) / ratio))).cast("int")
    rows = names.select("uid", "name", "k", step.alias("c"))
    parts = rows.groupBy("k", "c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiles = rows.join(parts, ["k", "c"]).groupBy("k", "c", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("uid", "name")).alias("rows"))
    after = parts.select("k", (F.col("c") - 1).alias("c"), F.col("parts").alias("next_parts"))
    to = tiles.join(parts, ["k", "c"]).join(after, ["k", "c"], "left")
    own = F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda x: F.struct(F.col("c").alias("c"), x.alias("part")))
    following = F.when(F.col("next_parts").isNull(), F.array().cast("array<struct<c:int,part:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("next_parts") - 1), lambda x: F.struct((F.col("c") + 1).alias("c"), x.alias("part"))))
    left = to.select("k", F.col("c").alias("c0"), F.col("part").alias("p0"), F.col("rows").alias("left"), F.explode(F.concat(own, following)).alias("t")).select("k", "c0", "p0", "left", "t.c", "t.part")
    same = (F.col("c0") == F.col("c")) & (F.col("p0") == F.col("part"))
    work = left.join(tiles, ["k", "c", "part"]).select("left", F.when(~same, F.col("rows")).alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                ids, a = x.values.field("uid").to_numpy(), x.values.field("name").to_pylist()
                others, b = (ids, None) if not y.is_valid else (y.values.field("uid").to_numpy(), y.values.field("name").to_pylist())
                found = list(_tile_pairs(a, b, ratio))
                if found:
                    p, q, r = zip(*found, strict=True)
                    u, v = ids[list(p)], others[list(q)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(r, pa.float64())], ["v", "u", "ratio"])

    return work.mapInArrow(compare, "v long, u long, ratio double")


def fuzzy_clusters(counts: DataFrame, ratio: float = 90.0) -> DataFrame:
    """Aliases from distinct names (name, n): in order of frequency, each name joins the most similar canonical name of
    as many words, the one that was opened first if several are, or becomes one.

    Pairs that are similar enough are found first, in parallel. Whether a name is canonical then depends on its earlier
    similar names only: it is an alias if one of these is canonical, and canonical once all of them are aliases. Rounds
    over the pairs settle all names; only names with similar ones take part. Cluster ids are hashes of the canonical name.
    """
    rows = counts.where("name <> ''").select("name", "n", F.size(T.tokens(F.col("name"))).alias("k")).orderBy(F.desc("n"), "name")
    names = checkpointed(rows.select(F.monotonically_increasing_id().alias("uid"), "name", "n", "k"))  # ids follow the order
    pairs = checkpointed(similar_pairs(names, ratio))
    waiting, aliases = pairs.select("u").distinct(), None
    while not waiting.isEmpty():
        x = pairs.join(waiting, "u").join(waiting.select(F.col("u").alias("v"), F.lit(True).alias("waits")), "v", "left")
        x = x.withColumn("alias", F.lit(None).cast("boolean")) if aliases is None else x.join(aliases.select(F.col("u").alias("v"), F.lit(True).alias("alias")), "v", "left")
        state = checkpointed(x.groupBy("u").agg(F.bool_or(F.col("waits").isNull() & F.col("alias").isNull()).alias("joins"), F.bool_or(F.col("waits").isNotNull()).alias("waits")))
        found = state.where("joins").select("u")
        aliases = found if aliases is None else aliases.union(found)
        waiting = state.where("not joins and waits").select("u")
    if aliases is None:
        best = names.limit(0).select(F.col("uid").alias("u"), F.col("uid").alias("v"))
    else:
        best = pairs.join(aliases, "u").join(aliases.select(F.col("u").alias("v")), "v", "left_anti").groupBy("u").agg(F.max_by("v", F.struct("ratio", -F.col("v"))).alias("v"))
    own = names.join(best, F.col("uid") == F.col("u"), "left").select("name", "n", "u", F.coalesce("v", "uid").alias("head"))
    done = own.join(names.select(F.col("uid").alias("head"), F.col("name").alias("canonical_name")), "head")
    method = F.when(F.col("u").isNull(), "self").otherwise("fuzzy")
    return done.select("canonical_name", F.col("name").alias("alias_name"), F.col("n").alias("alias_count"), F.xxhash64("canonical_name").alias("cluster_id"), method.alias("method"))


def drop_audit(aliases: DataFrame, dropped: DataFrame) -> DataFrame:
    """Clusters, aliases and rows that ``drop_clusters`` takes away and leaves."""
    gone = dropped.select("cluster_id").distinct().withColumn("gone", F.lit(True))
    x = aliases.join(gone, "cluster_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return x.groupBy("gone").agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("aliases"), F.sum("alias_count").alias("rows"))


def bucket_examples(buckets: DataFrame, top: int = 3, sample: int = 2) -> DataFrame:
    """Of each bucket the most frequent names, and of each bucket and reason names in the order of a hash."""
    best = Window.partitionBy("bucket").orderBy(F.desc("total_count"), "canonical_name")
    some = Window.partitionBy("bucket", "second_reason").orderBy(F.md5("canonical_name"), "canonical_name")
    one = buckets.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("bucket", F.lit("top").alias("kind"), F.lit(None).cast("string").alias("reason"), "rank", "canonical_name")
    two = buckets.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= sample).select("bucket", F.lit("sample").alias("kind"), F.col("second_reason").alias("reason"), "rank", "canonical_name")
    return one.unionByName(two)


def judge_batches(pairs: DataFrame, order: list[Column], line: Column, size: int = 20) -> DataFrame:
    """Numbered lines of pairs in batches of ``size``, one prompt text per batch."""
    from .cleaning import numbered

    x = numbered(pairs, order).withColumn("batch", F.floor(F.col("place") / size).cast("int")).withColumn("item", (F.pmod("place", F.lit(size)) + 1).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("item", line.alias("line")))), lambda r: F.concat(r["item"].cast("string"), F.lit(". "), r["line"]))
    return x.groupBy("batch").agg(F.array_join(lines, "\n").alias("prompt"), F.count("*").alias("items"))


def review_records(aliases: DataFrame, merges: DataFrame, forms: int = 3) -> DataFrame:
    """Of each cluster its most frequent forms and the clusters that it might merge into (source_id, target_id, ratio)."""
    top = aliases.groupBy("cluster_id").agg(F.max("canonical_name").alias("canonical_name"), F.sum("alias_count").alias("total_count"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("alias_count")).alias("minus"), "alias_name"))), 1, forms).alias("f"))
    to = merges.groupBy(F.col("source_id").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("minus"), "target_id"))).alias("m"))
    return top.join(to, "cluster_id", "left").select("cluster_id", "canonical_name", "total_count", F.transform("f", lambda x: x["alias_name"]).alias("forms"), F.coalesce(F.transform("m", lambda x: x["target_id"]), F.array().cast("array<long>")).alias("suggestions"))
