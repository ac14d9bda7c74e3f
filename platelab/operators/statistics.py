"""Weighted distributions, rank correlations, binned trends and other statistics of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.session import checkpointed

from .cleaning import numbered
from .ordering import ranked, weighted_quantiles


def weighted_mean(value: Column, weight: Column) -> Column:
    known = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(known))


def box_stats(rows: DataFrame, group: str, value: str, weight: str, least: int = 150, order: str | None = None) -> DataFrame:
    """Weighted box of each group with enough rows: 5, 25, 50, 75 and 95 percent, mean, rows, weight, and ``place``, from
    0 for the group whose median is highest, which is the worst; ties go by group."""
    q = weighted_quantiles(rows, [group], value, weight, (0.05, 0.25, 0.5, 0.75, 0.95), order)
    n = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(group).agg(F.count("*").alias("n"), weighted_mean(F.col(value), F.col(weight)).alias("mean"), F.sum(weight).alias("weight"))
    boxes = checkpointed(n.where(F.col("n") >= least).join(q, group))
    return numbered(boxes, [F.desc("q50"), F.col(group)])


def spearman_matrix(rows: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rank correlation of each pair of columns over the rows that have both; ranks are ordinal, ties by key."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    long = rows.select(F.col(key).alias("key"), each.alias("p")).select("key", "p.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    first = ranked(long, ["a", "b"], F.col("x"), F.col("key")).select("key", "a", "b", "y", F.col("place").cast("double").alias("rx"))
    both = ranked(first, ["a", "b"], F.col("y"), F.col("key")).withColumn("ry", F.col("place").cast("double"))
    return both.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def weighted_spearman(rows: DataFrame, x: str, y: str, weight: str, key: str) -> DataFrame:
    """Weighted correlation of ordinal ranks."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(weight).cast("double").alias("w"))
    first = ranked(known, [], F.col("x"), F.col("key")).select("key", "y", "w", F.col("place").cast("double").alias("rx"))
    r = ranked(first, [], F.col("y"), F.col("key")).select("w", "rx", F.col("place").cast("double").alias("ry"))
    s = r.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * c).alias(n) for n, c in {"x": F.col("rx"), "y": F.col("ry"), "xx": F.col("rx") * F.col("rx"), "yy": F.col("ry") * F.col("ry"), "xy": F.col("rx") * F.col("ry")}.items()])
    cov = lambda a, b, ab: F.col(ab) / F.col("w") - F.col(a) / F.col("w") * F.col(b) / F.col("w")
    return s.select((cov("x", "y", "xy") / F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy"))).alias("rho"))


def binned_trend(rows: DataFrame, x: str, y: str, weight: str, key: str, bins: int = 10, least: int = 20) -> DataFrame:
    """Weighted median of ``y`` in bins of ``x`` between its weighted quantiles; a row on an edge is in both bins."""
    shares = [i / bins for i in range(bins + 1)]
    edges = weighted_quantiles(rows, [], x, weight, shares, key).select(F.array_sort(F.array_distinct(F.array(*[f"q{round(s * 100):02d}" for s in shares]))).alias("e"))
    spans = edges.select(F.posexplode(F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1), lambda a, b: F.struct(a.alias("low"), b.alias("high")))).alias("bin", "s")).select("bin", "s.*")
    inside = rows.join(F.broadcast(spans), (F.col(x) >= F.col("low")) & (F.col(x) <= F.col("high")))
    n = inside.groupBy("bin", "low", "high").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(weighted_quantiles(inside, ["bin"], y, weight, (0.5,), key).withColumnRenamed("q50", "median"), "bin")


def log_bins(rows: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """Median of ``y`` in bins of equal width on the log of ``x``."""
    at = F.width_bucket(F.log10(x), F.log10(F.lit(low)), F.log10(F.lit(high)), F.lit(bins))
    return rows.where(F.col(x) > 0).groupBy(at.alias("bin")).agg(F.median(y).alias("median"), F.count("*").alias("n"))


def median_price(rows: DataFrame, key: str, price: str) -> DataFrame:
    return rows.where(F.col(price) > 0).groupBy(key).agg(F.median(price).alias("median_price"), F.count("*").alias("n"))


def capped(rows: DataFrame, column: str, share: float = 0.98) -> DataFrame:
    """Rows up to the quantile of the column."""
    cap = rows.agg(F.percentile(column, F.lit(share)).alias("cap"))
    return rows.join(F.broadcast(cap)).where(F.col(column) <= F.col("cap")).drop("cap")


def per_serving(value: Column, mass_g: Column, servings: Column) -> Column:
    return value * mass_g / 1000 / servings


def functional_units(rows: DataFrame, impact: str, energy_kcal: str, protein_g: str, mass_g: str, servings: int = 4) -> DataFrame:
    """An impact by serving, kg, 1,000 kcal and 100 g of protein."""
    v = F.col(impact)
    return rows.select("*", F.try_divide(v, F.lit(float(servings))).alias("per_serving"), F.try_divide(v * 1000, F.col(mass_g)).alias("per_kg"), F.try_divide(v * 1000, F.col(energy_kcal)).alias("per_1000_kcal"), F.try_divide(v * 100, F.col(protein_g)).alias("per_100_g_protein"))


def area_stats(rows: DataFrame, area: str, price: str, lat: str, lng: str, metrics: Sequence[str], least: int = 40) -> DataFrame:
    """Medians of price and place and means of metrics by area, where there are enough rows with a place."""
    x = rows.where(F.col(area).isNotNull() & F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return x.groupBy(area).agg(F.count("*").alias("n"), F.median(price).alias("price"), F.median(lat).alias("lat"), F.median(lng).alias("lng"), *[F.avg(m).alias(m) for m in metrics]).where(F.col("n") >= least)


def unified_table(base: DataFrame, parts: Sequence[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """``base`` with renamed columns of each part (frame, key, order, {new: old}); the last row of a key in that order
    counts."""
    out = base
    for frame, key, order, names in parts:
        one = frame.groupBy(key).agg(F.max_by(F.struct(*[F.col(old).alias(new) for new, old in names.items()]), order).alias("x")).select(key, "x.*")
        out = out.join(one, key, "left")
    return out


def clean_metric(rows: DataFrame, column: str, log: bool) -> DataFrame:
    """Rows with a finite value, above 0 if its log is shown."""
    v = F.col(column)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rows.where(ok & (v > 0) if log else ok)


def menu_sample(rows: DataFrame, menu: str, dish: str, order: Sequence[Column], metric: str, k: int) -> DataFrame:
    """``k`` dishes of each menu, evenly spaced by metric; of a dish's rows the first counts."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(menu, dish).orderBy(*order))).where("r = 1").drop("r")
    w = Window.partitionBy(menu)
    x = first.withColumn("r", F.row_number().over(w.orderBy(metric, dish))).withColumn("n", F.count("*").over(w))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (k - 1) + 0.5) + 1))
    return x.where(F.array_contains(picks, F.col("r").cast("long"))).drop("r", "n")


def menu_blend(rows: DataFrame, menu: str, ghg: str, score: str, share: float = 0.55) -> DataFrame:
    """Blend of scaled log emission and scaled score within each menu, and what the best saves against the worst."""
    w = Window.partitionBy(menu)
    span = lambda c: F.coalesce(F.try_divide(c - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    x = rows.where(F.col(ghg) > 0).withColumn("blend", share * span(F.log(ghg)) + (1 - share) * span(F.col(score).cast("double")))
    saving = x.groupBy(menu).agg(F.max_by(ghg, "blend").alias("worst"), F.min_by(ghg, "blend").alias("best"))
    return x.join(saving.select(menu, F.try_divide(100 * (F.col("worst") - F.col("best")), "worst").alias("saving_pct")), menu)


def clipped_colour(rows: DataFrame, column: str) -> DataFrame:
    """0 to 1 between the 2nd and 98th percentile."""
    ends = rows.agg(F.percentile(column, F.lit(0.02)).alias("low"), F.percentile(column, F.lit(0.98)).alias("high"))
    v = F.greatest(F.least(F.col(column), F.col("high")), F.col("low"))
    return rows.join(F.broadcast(ends)).withColumn("colour", F.try_divide(v - F.col("low"), F.col("high") - F.col("low"))).drop("low", "high")


def provenance(rows: DataFrame, source: str, pattern: str, mass: str, occurrences: str) -> DataFrame:
    """Ingredients, occurrences and mass by the kind that a provenance text names."""
    kind = F.coalesce(F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")), F.lit("other"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("ingredients"), F.sum(occurrences).alias("occurrences"), F.sum(mass).alias("mass"))


def similarity(pairs: DataFrame, dishes: DataFrame) -> DataFrame:
    """Shared ingredients of pairs (i, j): Jaccard index and shared mass; dishes have idx and ingredients as a map."""
    a, b = dishes.select(F.col("idx").alias("i"), F.col("ingredients").alias("a")), dishes.select(F.col("idx").alias("j"), F.col("ingredients").alias("b"))
    x = pairs.join(a, "i").join(b, "j")
    both = F.array_intersect(F.map_keys("a"), F.map_keys("b"))
    shared = F.aggregate(F.transform(both, lambda k: F.least(F.element_at("a", k), F.element_at("b", k))), F.lit(0.0), lambda s, v: s + v)
    return x.select("i", "j", F.try_divide(F.size(both).cast("double"), F.size(F.array_union(F.map_keys("a"), F.map_keys("b")))).alias("jaccard"), shared.alias("shared_mass"))


def price_distribution(rows: DataFrame, price: str, kept: Column, width: float) -> DataFrame:
    """Histogram of positive prices, of all rows and of those that are kept."""
    return rows.where(F.col(price) > 0).groupBy(F.floor(F.col(price) / width).alias("bin")).agg(F.count("*").alias("n_all"), F.count_if(kept).alias("n_kept"))


def complete_boxes(rows: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Unweighted boxes by group over rows in which every metric is above 0."""
    ok = F.lit(True)
    for m in metrics:
        ok = ok & (F.col(m) > 0)
    cols = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), *[F.percentile(m, F.lit(p)).alias(f"{m}_{n}") for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))])]
    return rows.where(ok).groupBy(group).agg(F.count("*").alias("n"), *cols)


def area_income(rows: DataFrame, incomes: DataFrame, area: str, income: str, share: float = 0.99) -> DataFrame:
    """Rows of areas with a known income, without the areas above the quantile of the joined incomes."""
    return capped(rows.join(incomes, area).where(F.col(income).isNotNull()), income, share)
