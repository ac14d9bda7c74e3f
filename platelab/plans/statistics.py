"""Queries over weighted statistics, ranks, trends and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelab.operators import manifold, statistics

from . import inputs as I
from .registry import query


def wq(rows: str, groups: str, value: str, weight: str, order: str, shares: list[float]) -> str:
    by = f"PARTITION BY {groups}" if groups else ""
    comma = f"{groups}, " if groups else ""
    at = lambda q: f"max(CASE WHEN c <= {q} AND c2 > {q} THEN v + (v2 - v) * ({q} - c) / (c2 - c) WHEN c0 IS NULL AND c > {q} THEN v WHEN c2 IS NULL AND c <= {q} THEN v END)"
    cols = ", ".join(f"{at(float(q))} AS q{round(q * 100):02d}" for q in shares)
    return f"""SELECT {comma}{cols} FROM (SELECT {comma}v, c, lead(v) OVER w AS v2, lead(c) OVER w AS c2, lag(c) OVER w AS c0 FROM (SELECT {comma}{value} AS v, {order} AS o, (sum({weight}) OVER ({by} ORDER BY {value}, {order} ROWS UNBOUNDED PRECEDING) - {weight} / 2) / sum({weight}) OVER ({by}) AS c FROM {rows} WHERE {value} IS NOT NULL AND {weight} > 0) WINDOW w AS ({by} ORDER BY v, o)) {"GROUP BY " + groups if groups else ""}"""


@query("weighted_quantiles", "SELECT c_nationkey, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75 FROM (" + wq("(SELECT *, (c_custkey % 13 + 1)::DOUBLE AS w FROM customer)", "c_nationkey", "c_acctbal", "w", "c_custkey", [0.25, 0.5, 0.75]) + ")")
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "customer").withColumn("w", (F.col("c_custkey") % 13 + 1).cast("double"))
    q = statistics.weighted_quantiles(x, ["c_nationkey"], "c_acctbal", "w", (0.25, 0.5, 0.75), "c_custkey")
    return q.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")])


ONE_GROUP = "(SELECT CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS w, l_orderkey * 10 + l_linenumber AS k FROM lineitem)"


@query("weighted_quantiles_all", "SELECT round(q01, 4) AS q01, round(q50, 4) AS q50, round(q99, 4) AS q99 FROM (" + wq(ONE_GROUP, "", "v", "w", "k", [0.01, 0.5, 0.99]) + ")")
def weighted_quantiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group of all rows, with many ties."""
    x = I.read(spark, sf_dir, "lineitem").selectExpr("CAST(l_extendedprice AS DOUBLE) AS v", "CAST(l_quantity AS DOUBLE) AS w", "l_orderkey * 10 + l_linenumber AS k")
    return statistics.weighted_quantiles(x, [], "v", "w", (0.01, 0.5, 0.99), "k").select(*[F.round(c, 4).alias(c) for c in ("q01", "q50", "q99")])


@query(
    "box_stats",
    "WITH x AS (SELECT *, (c_custkey % 13 + 1)::DOUBLE AS w FROM customer), n AS (SELECT c_mktsegment, count(*) AS n, round(sum(w * c_acctbal) / sum(w), 4) AS mean, sum(w) AS weight FROM x GROUP BY 1 HAVING count(*) >= 150) SELECT c_mktsegment, n, mean, weight, round(q05, 4) AS q05, round(q50, 4) AS q50, round(q95, 4) AS q95, row_number() OVER (ORDER BY q50 DESC, c_mktsegment) - 1 AS place FROM n JOIN ("
    + wq("x", "c_mktsegment", "c_acctbal", "w", "c_custkey", [0.05, 0.5, 0.95])
    + ") USING (c_mktsegment)",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "customer").withColumn("w", (F.col("c_custkey") % 13 + 1).cast("double"))
    b = statistics.box_stats(x, "c_mktsegment", "c_acctbal", "w", 150, "c_custkey")
    return b.select("c_mktsegment", "n", F.round("mean", 4).alias("mean"), "weight", *[F.round(c, 4).alias(c) for c in ("q05", "q50", "q95")], F.col("place").cast("long").alias("place"))


PAIRS = "(SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS a, l_extendedprice AS b, CASE WHEN l_linenumber <> 3 THEN l_discount END AS c FROM lineitem)"


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = I.read(spark, sf_dir, "lineitem")
    return li.selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_quantity AS a", "l_extendedprice AS b", "CASE WHEN l_linenumber <> 3 THEN l_discount END AS c").groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("c").alias("c"))


@query(
    "spearman",
    f"WITH d AS (SELECT k, max(a) AS a, max(b) AS b, max(c) AS c FROM {PAIRS} GROUP BY k), p AS (SELECT k, 'a' AS a, 'b' AS b, a AS x, b AS y FROM d UNION ALL SELECT k, 'a', 'c', a, c FROM d UNION ALL SELECT k, 'b', 'c', b, c FROM d), r AS (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY x, k) AS rx, row_number() OVER (PARTITION BY a, b ORDER BY y, k) AS ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL) SELECT a, b, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY ALL",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman_matrix(_measures(spark, sf_dir), ["a", "b", "c"], "k").withColumn("rho", F.round("rho", 6))


@query(
    "weighted_spearman",
    f"WITH d AS (SELECT k, max(a) AS a, max(b) AS b, (k % 7 + 1)::DOUBLE AS w FROM {PAIRS} GROUP BY k), r AS (SELECT w, row_number() OVER (ORDER BY a, k)::DOUBLE AS x, row_number() OVER (ORDER BY b, k)::DOUBLE AS y FROM d), s AS (SELECT sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM r) SELECT round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 6) AS rho FROM s",
)
def weighted_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _measures(spark, sf_dir).withColumn("w", F.col("k") % 7 + 1)
    return statistics.weighted_spearman(x, "a", "b", "w", "k").withColumn("rho", F.round("rho", 6))


@query("weighted_mean", "SELECT c_mktsegment, round(sum(c_acctbal * (c_custkey % 5)) / sum(c_custkey % 5), 6) AS mean FROM customer GROUP BY 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = statistics.weighted_mean(F.col("c_acctbal"), F.col("c_custkey") % 5)
    return I.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(mean, 6).alias("mean"))


@query(
    "binned_trend",
    "WITH x AS (SELECT *, 1.0::DOUBLE AS w FROM customer), e AS (" + wq("x", "", "c_acctbal", "w", "c_custkey", [0.0, 0.25, 0.5, 0.75, 1.0]) + "), s AS (SELECT 0 AS bin, q00 AS low, q25 AS high FROM e UNION ALL SELECT 1, q25, q50 FROM e UNION ALL SELECT 2, q50, q75 FROM e UNION ALL SELECT 3, q75, q100 FROM e) SELECT bin::INT AS bin, round(low, 4) AS low, round(high, 4) AS high, n, round(q50, 4) AS median FROM (SELECT bin, low, high, count(*) AS n FROM x JOIN s ON c_acctbal BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 20) JOIN (" + wq("(SELECT x.*, bin FROM x JOIN s ON c_acctbal BETWEEN low AND high)", "bin", "c_custkey", "w", "c_custkey", [0.5]) + ") USING (bin)",
)
def binned_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "customer").withColumn("w", F.lit(1.0))
    return statistics.binned_trend(x, "c_acctbal", "c_custkey", "w", "c_custkey", 4).select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n", F.round("median", 4).alias("median"))


@query("median_price", "SELECT p_name, round(median(p_retailprice), 4) AS median_price, count(*) AS n FROM part WHERE p_retailprice > 0 GROUP BY 1")
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.median_price(I.read(spark, sf_dir, "part"), "p_name", "p_retailprice").withColumn("median_price", F.round("median_price", 4))


@query("capped", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.98) FROM orders)")
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.capped(I.read(spark, sf_dir, "orders"), "o_totalprice").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("area_stats", "SELECT c_nationkey, count(*) AS n, round(median(c_acctbal), 4) AS price, round(avg(c_custkey), 4) AS c_custkey FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 40")
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "customer").withColumn("lat", F.lit(1.0)).withColumn("lng", F.lit(2.0))
    return statistics.area_stats(x, "c_nationkey", "c_acctbal", "lat", "lng", ["c_custkey"]).select("c_nationkey", "n", F.round("price", 4).alias("price"), F.round("c_custkey", 4).alias("c_custkey"))


@query(
    "menu_sample",
    "WITH f AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1), r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_name) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM f), k AS (SELECT DISTINCT p_brand, floor(i * (n - 1) / 4 + 0.5)::BIGINT + 1 AS r FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS i)) SELECT p_brand, p_name, p_partkey FROM r JOIN k USING (p_brand, r)",
)
def menu_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.menu_sample(I.read(spark, sf_dir, "part"), "p_brand", "p_name", [F.col("p_partkey")], "p_retailprice", 5).select("p_brand", "p_name", "p_partkey")


@query("provenance", "SELECT CASE WHEN regexp_extract(p_type, '^(ECON|PROMO)', 1) = '' THEN 'other' ELSE regexp_extract(p_type, '^(ECON|PROMO)', 1) END AS kind, count(*) AS ingredients, sum(p_size)::BIGINT AS occurrences, round(sum(p_retailprice), 2) AS mass FROM part GROUP BY 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.provenance(I.read(spark, sf_dir, "part"), "p_type", "^(ECON|PROMO)", "p_retailprice", "p_size").withColumn("mass", F.round("mass", 2))


@query("price_distribution", "SELECT floor(p_retailprice / 50)::BIGINT AS bin, count(*) AS n_all, count(*) FILTER (WHERE p_type <> 'PROMO') AS n_kept FROM part WHERE p_retailprice > 0 GROUP BY 1")
def price_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.price_distribution(I.read(spark, sf_dir, "part"), "p_retailprice", F.col("p_type") != "PROMO", 50.0)


@query("complete_boxes", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(quantile_cont(o_totalprice, 0.25), 4) AS o_totalprice_p25, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice_median FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def complete_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = statistics.complete_boxes(I.read(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])
    return x.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("o_totalprice_mean", "o_totalprice_p25", "o_totalprice_median")])


@query("overlay_rank", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1) / count(p_size) OVER (), 6) AS share FROM part")
def overlay_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = manifold.rank_share(I.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")
    return x.select("p_partkey", F.round("share", 6).alias("share"))


@query("minmax_map", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 1000, 2) AS x FROM part")
def minmax_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.scaled(I.read(spark, sf_dir, "part"), {"x": F.col("p_retailprice")}).select("p_partkey", "x")


@query(
    "distinctive_tokens",
    "WITH x AS (SELECT p_partkey, p_type, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part), t AS (SELECT p_type, token, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM t GROUP BY 1), s AS (SELECT p_type, token, tf * ln(((SELECT count(DISTINCT p_type) FROM t) + 1.0) / (df + 0.5)) * CASE WHEN token IN ('new', 'old') THEN 0.25 ELSE 1 END AS score FROM t JOIN d USING (token)) SELECT p_type, rank::INT AS rank, token, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(score, 9) DESC, token DESC) AS rank FROM s) WHERE rank <= 6",
)
def distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.distinctive_tokens(I.read(spark, sf_dir, "part"), "p_type", F.split("p_name", " "), ["new", "old"]).withColumn("score", F.round("score", 6))


@query("cuisine_vote", "WITH s AS (SELECT o_custkey, o_orderpriority AS l, sum(o_totalprice) AS w FROM orders GROUP BY ALL) SELECT o_custkey, first(l ORDER BY w DESC, l) AS label FROM s GROUP BY 1")
def cuisine_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.weighted_vote(I.read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority"), F.col("o_totalprice"), "Other")


@query(
    "dish_vectors",
    "WITH r AS (SELECT l_orderkey AS dish, l_quantity AS w, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM lineitem JOIN embeddings ON vec_id = l_partkey % (SELECT max(vec_id) + 1 FROM embeddings)), s AS (SELECT dish, d, sum(w * v) AS s FROM (SELECT dish, w, unnest(v) AS v, generate_subscripts(v, 1) AS d FROM r) GROUP BY ALL), n AS (SELECT dish, sqrt(sum(s * s)) AS n FROM s GROUP BY 1) SELECT dish, round(sum(s / n * d), 4) AS checksum FROM s JOIN n USING (dish) GROUP BY 1",
)
def dish_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.read(spark, sf_dir, "embeddings")
    count = e.select(F.max("vec_id") + 1).first()[0] or 1
    rows = I.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dish"), (F.col("l_partkey") % count).alias("ingredient"), F.col("l_quantity").alias("weight"))
    v = manifold.dish_vectors(rows, e.selectExpr("vec_id AS ingredient", "embedding AS vector"))
    return v.select("dish", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query("gazetteer", "SELECT p_size % 5 AS region, count(*) AS n, round(avg(log10(p_partkey + 1)), 6) AS mean_log, sum(p_partkey + 1)::BIGINT AS total FROM part GROUP BY 1")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("p_size % 5 AS region", "p_partkey + 1 AS count", "p_retailprice AS x", "p_retailprice AS y")
    return manifold.gazetteer(x, "region").select("region", "n", F.round("mean_log", 6).alias("mean_log"), "total")


@query("log_bins", "WITH x AS (SELECT CASE WHEN log10(o_totalprice) < 3 THEN 0 WHEN log10(o_totalprice) >= 6 THEN 7 ELSE CAST(floor((log10(o_totalprice) - 3) / 3 * 6) AS BIGINT) + 1 END AS bin, o_totalprice FROM orders WHERE o_totalprice > 0) SELECT bin, round(median(o_totalprice), 4) AS median, count(*) AS n FROM x GROUP BY 1")
def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = statistics.log_bins(I.read(spark, sf_dir, "orders"), "o_totalprice", "o_totalprice", 1000.0, 1_000_000.0, 6)
    return x.withColumn("median", F.round("median", 4))


@query(
    "menu_blend",
    "WITH x AS (SELECT p_partkey, p_brand, p_retailprice AS g, p_size::DOUBLE AS s FROM part WHERE p_retailprice > 0), y AS (SELECT *, 0.55::DOUBLE * coalesce((ln(g) - min(ln(g)) OVER w) / nullif(max(ln(g)) OVER w - min(ln(g)) OVER w, 0), 0) + 0.45::DOUBLE * coalesce((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0), 0) AS blend FROM x WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, round(blend, 6) AS blend FROM y",
)
def menu_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.menu_blend(I.read(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_size").select("p_partkey", F.round("blend", 6).alias("blend"))


@query("clipped_colour", "WITH e AS (SELECT quantile_cont(o_totalprice, 0.02) AS lo, quantile_cont(o_totalprice, 0.98) AS hi FROM orders) SELECT o_orderkey, round((greatest(least(o_totalprice, hi), lo) - lo) / (hi - lo), 6) AS colour FROM orders, e")
def clipped_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.clipped_colour(I.read(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("colour", 6).alias("colour"))


@query(
    "functional_units",
    "SELECT o_orderkey, round(o_totalprice / 4, 4) AS per_serving, round(o_totalprice * 1000 / (o_custkey + 7), 4) AS per_kg, round(o_totalprice * 1000 / nullif(o_orderkey % 13, 0), 4) AS per_1000_kcal, round(o_totalprice * 100 / (o_orderkey % 11 + 3), 4) AS per_100_g_protein FROM orders",
)
def functional_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice", "CAST(o_orderkey % 13 AS DOUBLE) AS kcal", "CAST(o_orderkey % 11 + 3 AS DOUBLE) AS protein", "CAST(o_custkey + 7 AS DOUBLE) AS mass")
    out = statistics.functional_units(x, "o_totalprice", "kcal", "protein", "mass")
    return out.select("o_orderkey", *[F.round(c, 4).alias(c) for c in ("per_serving", "per_kg", "per_1000_kcal", "per_100_g_protein")])


@query("colour_ranks", "SELECT p_type, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::INT AS rank FROM part GROUP BY 1")
def colour_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.colour_ranks(I.read(spark, sf_dir, "part"), "p_type")


@query("density_grid", "SELECT CAST(least(floor((p_partkey % 1000) / 1000.0 * 20), 19) AS INT) AS cx, CAST(least(floor((p_partkey * 7 % 1000) / 1000.0 * 20), 19) AS INT) AS cy, round(sum(log10(p_size + 1)), 6) AS weight FROM part GROUP BY ALL")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("CAST(p_partkey % 1000 AS DOUBLE) AS x", "CAST(p_partkey * 7 % 1000 AS DOUBLE) AS y", "p_size AS count")
    return manifold.density_grid(x, 20).withColumn("weight", F.round("weight", 6))


GRID = "SELECT CAST(least(floor((p_partkey % 1000) / 1000.0 * 20), 19) AS INT) AS cx, CAST(least(floor((p_partkey * 7 % 1000) / 1000.0 * 20), 19) AS INT) AS cy, sum(log10(p_size + 1)) AS weight FROM part GROUP BY ALL"


@query(
    "smoothed_grid",
    f"WITH g AS ({GRID}), k AS (SELECT d, exp(-d * d / 8.0) / (2 * sqrt(2 * pi())) AS k FROM (SELECT unnest(range(-6, 7)) AS d)) SELECT (cx + a.d)::INT AS cx, (cy + b.d)::INT AS cy, round(sum(weight * a.k * b.k), 6) AS weight FROM g, k a, k b GROUP BY ALL",
)
def smoothed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = I.read(spark, sf_dir, "part").selectExpr("CAST(p_partkey % 1000 AS DOUBLE) AS x", "CAST(p_partkey * 7 % 1000 AS DOUBLE) AS y", "p_size AS count")
    return manifold.smoothed_grid(manifold.density_grid(x, 20)).withColumn("weight", F.round("weight", 6))


@query("contribution_bars", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS bar FROM lineitem")
def contribution_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.contribution_bars(I.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("bar", 6).alias("bar"))


@query("projection")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.projection(I.read(spark, sf_dir, "embeddings").selectExpr("vec_id AS idx", "embedding AS vector"))
