"""Registered queries work on whole tables; small inputs against plain computation."""

import pytest
from pyspark.sql import functions as F

from platelab.operators import montecarlo
from platelab.plans import inputs, registry

SF = "/root/testdata/sf0.001"


def test_simulated_recipes_are_those_of_the_draws(spark):
    rows = [(r, p, f"i{(r + p) % 3}", 10.0 * p + r % 7, 1.0 + p, 2.0 + p, 2.0 + p if p % 2 else 5.0 + p) for r in (1, 59, 60, 61, 7_000_000) for p in (1, 2, 3, 4)] + [(9, 1, "one", 5.0, 3.0, 3.0, 3.0)]
    x = spark.createDataFrame(rows, "recipe_id long, position int, ingredient string, grams double, least double, mode double, most double")
    drawn = montecarlo.draws(x, 500).cache()
    got = {r["recipe_id"]: r for r in montecarlo.simulated(x, 500).collect()}
    want = {r["recipe_id"]: r for r in montecarlo.summarised(drawn).collect()}
    assert set(got) == set(want) and len(got) == 6
    for k in want:
        assert [got[k][c] for c in want[k].asDict()] == pytest.approx(list(want[k]), rel=1e-9)
    drivers = {(k, n + 1): tuple(d) for k, r in got.items() for n, d in enumerate(r["drivers"])}
    brute = {(r["recipe_id"], r["rank"]): (r["ingredient"], r["share"]) for r in montecarlo.variance_drivers(drawn).collect()}
    assert {k: d[0] for k, d in drivers.items()} == {k: d[0] for k, d in brute.items()}
    assert [drivers[k][1] for k in sorted(drivers)] == pytest.approx([brute[k][1] for k in sorted(brute)], rel=1e-9)


@pytest.mark.parametrize("name", ["monte_carlo_summary", "variance_drivers"])
def test_every_recipe_is_simulated(spark, name):
    known = inputs.recipe_rows(spark, SF).join(inputs.factors(spark, SF), "ingredient").select("recipe_id").distinct()
    got = registry.QUERIES[name](spark, SF).select("recipe_id").distinct()
    assert known.count() > 60 and known.exceptAll(got).count() == got.exceptAll(known).count() == 0


def test_simulation_makes_the_references_draws(spark):
    known = inputs.recipe_rows(spark, SF).where("recipe_id > 900 and recipe_id < 910").join(inputs.factors(spark, SF), "ingredient")
    low = F.col("ghg") / 2
    x = known.select("recipe_id", "position", "ingredient", "grams", low.alias("least"), F.col("ghg").alias("mode"), F.when(F.col("position") == 2, low).otherwise(F.col("ghg") * 2).alias("most"))
    want = {r["recipe_id"]: r["mean"] for r in montecarlo.summarised(montecarlo.draws(x, 10_000)).collect()}
    got = {r["recipe_id"]: r["mean"] for r in registry.QUERIES["monte_carlo_summary"](spark, SF).where("recipe_id > 900 and recipe_id < 910").collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_dishes_use_all_embeddings(spark, tmp_path):
    spark.createDataFrame([(1, 3, 2.0), (2, 903, 1.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, [1.0, 0.0] if i < 500 else [0.0, 1.0]) for i in range(1_000)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["dish"]: r["checksum"] for r in registry.QUERIES["dish_vectors"](spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 2.0}
