"""Running sums, ranks and weighted quantiles over groups of any size.

No task ever holds a whole group: rows are dealt into ranges of (group, order), each range is summed or numbered by
itself, and what a range starts from is made of the few rows that sum up the ranges before it. A window below always has
the range as part of its key, or runs over these summaries, of which a group has at most one per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.session import checkpointed


def _group(groups: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{g}`") for g in groups]) if groups else F.struct(F.lit(0).alias("all"))


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (g, o, ...) with the range of (g, o) that each has been dealt to."""
    return checkpointed(rows.repartitionByRange("g", "o").select("*", F.spark_partition_id().alias("range")))


def _starts(parts: DataFrame, part: str) -> DataFrame:
    """``parts`` (g, range, <part>, ...) with ``start``, the sum over the group's ranges before, and its ``total``."""
    by = Window.partitionBy("g")
    before = F.sum(part).over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("*", F.coalesce(before, F.lit(0)).alias("start"), F.sum(part).over(by).alias("total"))


def ranked(rows: DataFrame, groups: Sequence[str], value: Column, tie: Column) -> DataFrame:
    """``rows`` with place (from 1, in order of value and tie), rank (1 more than the rows of less value) and n (rows),
    within each group. Nulls of the value come first; a value that all rows share is as good as any other.

    The rank of a value that runs over the border of a range is that of its first row in an earlier range, which the
    summary of that range holds.
    """
    x = rows.select(_group(groups).alias("g"), F.struct(value.alias("v"), tie.alias("t")).alias("o"), F.struct("*").alias("row"))
    by = Window.partitionBy("g", "range")
    local = _in_ranges(x).select(
        "g", "range", "row", F.struct("o.v").alias("v"), F.row_number().over(by.orderBy("o")).alias("place"), F.rank().over(by.orderBy("o.v")).alias("rank")
    )
    parts = local.groupBy("g", "range").agg(F.count("*").alias("rows"), F.min("v").alias("first"), F.max("v").alias("last"), F.max("rank").alias("last_rank"))
    starts = checkpointed(_starts(parts, "rows"))
    runs = starts.groupBy("g", F.col("last").alias("first")).agg(F.min(F.col("start") + F.col("last_rank")).alias("run"))
    starts = starts.join(runs, ["g", "first"], "left").select("g", "range", "start", "total", F.least(F.col("run"), F.col("start") + 1).alias("run"))
    placed = local.join(starts, ["g", "range"])
    rank = F.when(F.col("rank") == 1, F.col("run")).otherwise(F.col("start") + F.col("rank"))
    return placed.select("row.*", (F.col("start") + F.col("place")).alias("place"), rank.alias("rank"), F.col("total").alias("n"))


def weighted_quantiles(rows: DataFrame, groups: Sequence[str], value: str, weight: str, shares: Sequence[float], order: str | None = None) -> DataFrame:
    """Quantiles of ``value`` by group as columns q<percent>: weights run up to the middle of each row, values between
    are interpolated, ends are clamped. Equal values stand in ``order``, else by weight.

    Rows of one value are one row first: of them only the sum of weights and the first and last weight matter. Rows of a
    range are looked at again only where a quantile falls inside the range; else its ends, from the summary, do.
    """
    x = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    at = F.col(order if order else weight)
    each = x.groupBy(_group(groups).alias("g"), F.col(value).alias("o")).agg(
        F.sum(weight).alias("w"), F.min_by(weight, F.struct(at, weight)).alias("w1"), F.max_by(weight, F.struct(at, weight)).alias("w2")
    )
    dealt = _in_ranges(each)
    ends = F.struct("o", "w", "w1", "w2")
    parts = dealt.groupBy("g", "range").agg(F.sum("w").alias("part"), F.min(ends).alias("low"), F.max(ends).alias("high"))
    starts = checkpointed(_starts(parts, "part"))

    def point(before: Column, weight: Column, v: Column) -> Column:
        return F.struct(((before + weight) / F.col("total")).alias("c"), v.alias("v"))

    upto, start = F.col("start") + F.col("part"), F.col("start")
    outer = F.array(
        point(start, F.col("low.w1") / 2, F.col("low.o")), point(start + F.col("low.w"), -F.col("low.w2") / 2, F.col("low.o")),
        point(upto - F.col("high.w"), F.col("high.w1") / 2, F.col("high.o")), point(upto, -F.col("high.w2") / 2, F.col("high.o")),
    )
    summary = starts.select("g", "range", "start", "total", outer.alias("points"))
    asked = F.array(*[F.lit(float(q)) for q in shares])
    hit = summary.where(F.exists(asked, lambda q: (q >= F.get("points", F.lit(0))["c"]) & (q < F.get("points", F.lit(3))["c"])))
    run = Window.partitionBy("g", "range").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.join(hit.drop("points"), ["g", "range"]).select("*", (F.col("start") + F.coalesce(F.sum("w").over(run), F.lit(0))).alias("b"))
    inner = inner.select("g", F.array(point(F.col("b"), F.col("w1") / 2, F.col("o")), point(F.col("b") + F.col("w"), -F.col("w2") / 2, F.col("o"))).alias("points"))
    points = summary.select("g", "points").unionByName(inner).select("g", F.explode("points").alias("p"))
    sides = [s for k, q in enumerate(shares) for s in (F.max(F.when(F.col("p.c") <= float(q), F.col("p"))).alias(f"a{k}"), F.min(F.when(F.col("p.c") > float(q), F.col("p"))).alias(f"b{k}"))]
    found = points.groupBy("g").agg(*sides)

    def quantile(k: int, q: float) -> Column:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (float(q) - a["c"]) / (b["c"] - a["c"]))

    return found.select(*[F.col("g")[g].alias(g) for g in groups], *[quantile(k, q).alias(f"q{round(q * 100):02d}") for k, q in enumerate(shares)])
