"""Mixing sources to target weights by hash thresholds.

Each source has a budget in words. Copies of a source nest: all its documents, as often as the whole source fits into
the budget, and then the documents whose hash lies below a threshold. The threshold comes from histograms: words are
summed by source and leading hash bits, the bucket in which the budget ends is the only one that is split further, and
so on until it holds one hash value, which is taken if that comes nearer to the budget. Documents are never sorted.

Everything is DataFrame and SQL functions. Defined results: null text has size 0; null source is a source, the last
one; rows that share a doc_id share a hash and are taken together, and so are rows without doc_id; sources without
words have target 0; a very long text is taken whole or not at all, so a source may miss its target by half of one;
an empty table gives an empty result; other columns are ignored by ``mix`` and kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.operators.cleaning import numbered

from .common import checkpointed, counted_side, nested

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEVELS = 5
BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """50 bits, the same in every engine that has MD5."""
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long"), 52 - LEVELS * BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) to (source, source_size, target): one row per source.

    Shares of the whole by weight, stopped at ``most`` times a source's size; what is over goes to the others by
    weight. Sharing out again can only stop further sources, so it is repeated until none is added. There may be as many
    sources as there are sites: they are put in order by ranges, and sums come from aggregations.
    """
    placed = numbered(sizes, [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpointed(placed.select("source", "source_size", weight.alias("w"), (most * F.col("source_size")).alias("cap")))
    total, rest = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    gone = 0
    while True:
        share = F.lit(float(total - gone)) * F.col("w") / F.lit(max(1, rest))
        stops = share > F.col("cap")
        now = tuple(ranked.agg(F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("w"))), F.lit(0))).first())
        if now == (gone, rest):
            return ranked.select("source", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(share).alias("target"))
        gone, rest = now


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sized`` (source, size, h) to (source, source_size, target, copies, threshold), one row per source.

    A document is taken ``copies`` times, and once more if its hash is below ``threshold``.
    """
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    goals = checkpointed(goals.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")))
    open_ = goals.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    found = goals.where("need <= 0").select("source", F.lit(0).cast("long").alias("threshold"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        side = counted_side(open_).alias("o")
        inside = sized.alias("s").join(side, F.col("s.source").eqNullSafe(F.col("o.source")) & (F.shiftright("s.h", shift + BITS) == F.col("o.prefix")))
        buckets = inside.groupBy(F.col("s.source").alias("source"), F.shiftright("s.h", shift).alias("prefix")).agg(
            F.sum("s.size").alias("words"), F.min("s.h").alias("low"), F.max("s.h").alias("high"), F.max("o.need").alias("need"), F.max("o.below").alias("under")
        )
        upto = F.col("under") + F.sum("words").over(Window.partitionBy("source").orderBy("prefix"))
        ends = buckets.withColumn("upto", upto).where("upto >= need and upto - words < need")
        ends = checkpointed(ends.select("source", "need", "prefix", (F.col("upto") - F.col("words")).alias("below"), "words", "low", "high"))
        taken = 2 * (F.col("need") - F.col("below")) > F.col("words")
        found = found.union(ends.where("low = high").select("source", F.col("low") + F.when(taken, 1).otherwise(0)))
        open_ = ends.where("low < high").select("source", "need", "prefix", "below")
        if open_.isEmpty():
            break
    return goals.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source"))).select("g.source", "source_size", "target", "copies", "threshold")


def _sized(docs: DataFrame) -> DataFrame:
    return checkpointed(docs.select("doc_id", "source", size(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")))


def _times() -> Column:
    return F.col("t.copies") + F.when(F.col("d.h") < F.col("t.threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    sized = _sized(docs)
    t = counted_side(thresholds(sized, weights, most)).alias("t")
    return sized.alias("d").join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.size", "t.source_size", "t.target", (F.col("d.size") * _times()).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it."""
    t = counted_side(thresholds(_sized(docs), weights, most)).alias("t")
    d = nested(docs, F.col("source"), doc_hash(F.col("doc_id")).alias("h")).alias("d")
    taken = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).where(_times() > 0)
    return taken.select("d.row", F.explode(F.sequence(F.lit(1), _times())).alias("time")).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT >> {52 - LEVELS * BITS} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS w,
    {MOST_COPIES} * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM w),
c AS (SELECT *, (total - gone)::DOUBLE * w / rest > cap AS stops FROM r),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()::BIGINT)::DOUBLE * w / sum(CASE WHEN stops THEN 0 ELSE w END) OVER ()::BIGINT END AS target FROM c),
n AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST_COPIES}) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
b AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h) - words)::BIGINT AS below FROM g),
x AS (SELECT b.source, h, copies + CASE WHEN below < target - copies * source_size AND (below + words <= target - copies * source_size OR 2 * (target - copies * source_size - below) > words) THEN 1 ELSE 0 END AS times
    FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h"""
