"""What the reviews of round 4 found, on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelab.operators import flexibility, manifold


def _spread(spark, n=700, dims=6):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[n // 2] = v[3]
    x = [(i * 3, [float(y) for y in v[i]], None if i % 19 == 0 else float(rng.integers(1, 40)), float("nan") if i % 23 == 0 else float(rng.integers(0, 9))) for i in range(n)]
    return v, x, spark.createDataFrame(x, "idx long, vector array<double>, ghg double, health double").repartition(5)


def test_dishes_face_blocks_without_shuffling_pairs_and_gains_come_once_a_radius(spark):
    v, x, rows = _spread(spark)
    work = flexibility._facing(rows.select("idx", "vector"), 16)
    plan = work._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Join" not in plan
    met = work.select(F.transform("one", lambda r: r["idx"]).alias("i"), F.transform("other", lambda r: r["idx"]).alias("j")).collect()
    assert sum(len(r["i"]) * len(r["j"]) for r in met) == 700**2 == len({(i, j) for r in met for i in r["i"] for j in r["j"]})
    assert max(len(r["i"]) for r in met) <= 64 and max(len(r["j"]) for r in met) < 300
    d = np.maximum(0.0, 1 - v @ v.T)
    np.fill_diagonal(d, 0.0)
    radii = (0.0, 0.05, 0.051, 0.2, 0.6)
    assert any((d[i] <= 0.05).sum() == (d[i] <= 0.051).sum() for i in range(700))  # no dish of its own at a radius
    got = {(r["idx"], r["radius"]): (r["neighbors"], r["ghg"], r["health"]) for r in flexibility.best_gains(rows, rows.drop("vector"), ["ghg"], ["health"], radii, 16).collect()}
    assert len(got) == 700 * len(radii)
    for i, (idx, _, ghg, health) in enumerate(x):
        for radius in radii:
            near = np.flatnonzero(d[i] <= radius)
            g = [x[j][2] for j in near if x[j][2] is not None]
            h = [x[j][3] for j in near if x[j][3] == x[j][3]]
            n, gain, better = got[idx, radius]
            assert n == len(near) and (gain is None) == (ghg is None or not g)
            assert gain is None or gain == pytest.approx((ghg - min(g)) / ghg)
            assert (better is None or better != better) if health != health or not h else better == pytest.approx(max(h) - health)


def test_wide_vectors_make_smaller_blocks(spark):
    rows = spark.range(300).select(F.col("id").alias("idx"), F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda k: (k % (F.col("id") + 2)).cast("float")).alias("vector"))
    assert max(r["n"] for r in flexibility._facing(rows, 16).select(F.size("other").alias("n")).collect()) < 60


def test_curves_have_one_list_of_values_a_gain(spark):
    g = spark.createDataFrame([(r, n, float(n * r) if n % 4 else None) for r in (0.5, 1.0) for n in range(9)], "radius double, neighbors long, ghg double")
    c = flexibility.curve(g, ["ghg"])
    assert c.columns == ["radius", "mean_neighbors", "median_neighbors", "ghg_mean", "ghg_p25", "ghg_median", "ghg_p75"]
    assert [list(r) for r in c.orderBy("radius").collect()] == [[r, 4.0, 4.0, *(r * np.array([4.0, *np.quantile([1, 2, 3, 5, 6, 7], (0.25, 0.5, 0.75))]))] for r in (0.5, 1.0)]
    assert c._jdf.queryExecution().analyzed().toString().count("percentile(") == 2


def test_dish_vectors_beyond_a_broadcast_still_shuffle_no_vectors(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 4000 END AS dish", "id * 31 % 45 AS ingredient", "CASE WHEN id % 11 <> 0 THEN CAST(id % 5 AS DOUBLE) END AS weight").unionAll(spark.sql("SELECT 5000L, 1L, CAST(NULL AS DOUBLE) UNION ALL SELECT 5001L, 2L, 0D UNION ALL SELECT 5002L, 99L, 1D"))
    vectors = spark.range(40).selectExpr("id AS ingredient", "array(CAST(cos(id) AS FLOAT), CAST(sin(id) AS FLOAT), CAST(id / 40D AS FLOAT)) AS vector")
    monkeypatch.setattr(manifold, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(manifold, "LINES", 500)  # dish 7 runs on over twenty blocks
    monkeypatch.setattr(manifold, "PART_BYTES", 100)
    faced = manifold.dish_vectors(rows, vectors)
    plan = faced._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = faced.collect()
    monkeypatch.setattr(manifold, "READ_BYTES", 0)
    want = {r["dish"]: r["vector"] for r in manifold.dish_vectors(rows, vectors).collect()}
    found = {r["dish"]: r["vector"] for r in got}
    assert len(got) == len(found) and set(found) == set(want) and None in found and 5002 not in found and found[5000] == found[5001] == [None] * 3
    for dish, v in want.items():
        assert found[dish] == (v if v[0] is None else pytest.approx(v))
