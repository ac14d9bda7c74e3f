"""Filters, counts and canonical spellings of categories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.functions import text as T
from platelab.session import checkpointed


def exclude_by_tags(rows: DataFrame, tags: Column, excluded: Iterable[str]) -> DataFrame:
    """Rows none of whose tags is excluded; rows without tags stay."""
    return rows.where(~F.coalesce(F.arrays_overlap(tags, T.literal_array(sorted(excluded))), F.lit(False)))


def exclude_values(rows: DataFrame, column: str, excluded: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not in the one column of ``excluded``; nulls stay."""
    (name,) = excluded.columns
    return rows.join(excluded.where(F.col(name).isNotNull()).distinct(), rows[column] == F.col(name), "left_anti")


def marked(rows: DataFrame, value: str, mark: str) -> DataFrame:
    """Values whose mark is an x in either case."""
    return rows.where(F.lower(F.trim(F.col(mark))) == "x").select(value)


def count_names(rows: DataFrame, name: Column) -> DataFrame:
    """Distinct non-empty names with their counts, the most frequent first."""
    found = rows.select(name.alias("name")).where("name <> ''")
    return found.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def count_summary(counts: DataFrame) -> DataFrame:
    """Names, rows and names that occur once."""
    return counts.agg(F.count("*").alias("names"), F.sum("n").alias("rows"), F.count_if(F.col("n") == 1).alias("singletons"))


def canonical_mapping(values: DataFrame, value: str, key: Column | None = None) -> DataFrame:
    """Each spelling to its canonical one: the most frequent of its key, then the most frequent of the winners that
    share a singular; ties go to the first in order."""
    counts = values.where(F.col(value) != "").groupBy(F.col(value).alias("spelling")).agg(F.count("*").alias("n"))
    keyed = counts.withColumn("k", T.cluster_key(F.col("spelling")) if key is None else key)
    pick = lambda names: F.min_by(names, F.struct(-F.col("n"), names))
    first = keyed.groupBy("k").agg(pick(F.col("spelling")).alias("winner"), F.sum("n").alias("n"))
    second = first.withColumn("s", T.singular_key(F.col("k"))).groupBy("s").agg(pick(F.col("winner")).alias("canonical"))
    return keyed.join(first.select("k", F.col("winner")), "k").withColumn("s", T.singular_key(F.col("k"))).join(second, "s").select("spelling", "n", "canonical")


def remap_tags(rows: DataFrame, tags: str, mapping: DataFrame, row_id: str) -> DataFrame:
    """Tag lists with canonical spellings, each once in first order; unmapped tags stay."""
    each = rows.select(row_id, F.posexplode(T.tags(F.col(tags))).alias("at", "tag"))
    named = each.join(mapping.select("spelling", "canonical"), each["tag"] == F.col("spelling"), "left")
    lists = named.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "tag").alias("tag")))).alias("l"))
    done = lists.select(row_id, F.array_join(F.array_distinct(F.transform("l", lambda x: x["tag"])), ", ").alias("new_tags"))
    return rows.join(done, row_id, "left").withColumn("changed", F.coalesce(F.col("new_tags") != F.col(tags), F.lit(False)))


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    """Single tags and whole lists with their counts."""
    single = rows.select(F.explode(T.tags(F.col(tags))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("kind", F.lit("single"))
    whole = rows.where(F.col(tags) != "").groupBy(F.col(tags).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("combined"))
    return single.union(whole)


def classify_categories(rows: DataFrame, category: str, exclude: Iterable[tuple[str, str]], unsure: Iterable[tuple[str, str]]) -> DataFrame:
    """verdict and label by the first pattern that fits; patterns that exclude come before ambiguous ones."""
    low = F.lower(F.coalesce(F.col(category), F.lit("")))
    out, maybe = T.first_rule(low, exclude), T.first_rule(low, unsure)
    return rows.withColumn("verdict", F.when(out.isNotNull(), "exclude").when(maybe.isNotNull(), "ambiguous").otherwise("keep")).withColumn("label", F.coalesce(out, maybe))


def merge_verdicts(parts: list[DataFrame], key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Verdict rows of all parts that say keep, most frequent first, and the counts by verdict and reason."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where(F.lower("verdict") == "keep").orderBy(F.desc("n"), key), every.groupBy("verdict", "reason").agg(F.count("*").alias("names"), F.sum("n").alias("rows"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``place`` from 0 in the given order, without a window over all rows: rows are dealt to ranges of the order,
    numbered within them, and the ranges' sizes are added up."""
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("within")))
    low = F.col("within") - F.shiftleft(F.col("range").cast("long"), 33)
    sizes = sorted(dealt.groupBy("range").count().collect())  # one row per range
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, first long"))
    return dealt.join(first, "range").withColumn("place", F.col("first") + low).drop("range", "within", "first")


def equal_chunks(rows: DataFrame, order: list[Column], chunks: int) -> DataFrame:
    """``chunk`` from 0: consecutive rows in chunks of one size, the last one smaller."""
    placed = numbered(rows, order)
    size = max(1, -(-rows.count() // chunks))
    return placed.withColumn("chunk", F.floor(F.col("place") / size).cast("int")).drop("place")


def shard(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """``shard``: rows dealt out one by one in order."""
    return numbered(rows, order).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).drop("place")


def changed_count(rows: DataFrame) -> DataFrame:
    """How many rows of ``remap_tags`` were changed."""
    return rows.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))


def without_flagged(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows that carry neither flag."""
    return rows.where(~F.coalesce(F.lower(F.trim(F.col(flag))), F.lit("")).isin("x", "?"))


def exported(rows: DataFrame, tags: Column, excluded: Iterable[str], name: str) -> DataFrame:
    """Rows without excluded tags, nulls as empty texts, in order of name."""
    kept = exclude_by_tags(rows, tags, excluded)
    return kept.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in kept.dtypes]).orderBy(name)


def review_split(verdicts: DataFrame, dropped: DataFrame, key: str, count: str, chunks: int = 3) -> DataFrame:
    """Rows to be reviewed that have not been dropped since, the most frequent first, in consecutive chunks."""
    left = verdicts.where(F.lower(F.trim("verdict")) == "review").join(dropped.select(key).distinct(), key, "left_anti")
    return equal_chunks(left, [F.desc(count), F.col(key)], chunks)


def applied_synonyms(rows: DataFrame) -> DataFrame:
    """Word and what it stands for, of rows (alias_token, canonical_token, notes) whose note begins with APPLY; words
    that stand for themselves are left out, and of a word's rows the last in order of what it stands for counts."""
    a, c = F.lower(F.trim("alias_token")), F.lower(F.trim("canonical_token"))
    return rows.where(F.coalesce(F.trim("notes"), F.lit("")).startswith("APPLY")).select(a.alias("word"), c.alias("canonical")).where("word <> canonical").groupBy("word").agg(F.max("canonical").alias("canonical"))
