"""What the reviews of round 3 found, on small inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platelab.operators import density, flexibility, impact, linkage, manifold, montecarlo, rules
from platelab.operators import vocabulary as V
from test_scale_operators import plain_regions


def test_pedigree_means_half_way_are_rounded_as_in_sql(spark):
    rows = [(1, "a", 4.6, 158.01898620102585), (1, "b", 1.9, 474.0569586030776), (2, "a", 2.8, 695.492343595528), (2, "b", 1.9, 1580.6644172625636), (2, "c", 3.7, 0.0)]
    rows += [(3, n, v, 0.0) for n, v in zip("abcdefgh", (1.0, 1.0, 1.0, 1.0, 1.9, 1.9, 1.9, 2.8), strict=True)]
    got = {r["recipe_id"]: r["average"] for r in impact.product_pedigree(spark.createDataFrame(rows, "recipe_id long, ingredient string, average double, ghg_g double")).collect()}
    assert got == {1: 2.58, 2: 2.17, 3: 1.56}


def test_names_of_up_to_64_letters_and_longer_ones_share_a_tile():
    short, long = "a" * 30 + "b" * 34, "a" * 30 + "b" * 36
    names = [short, long, "a" * 29 + "b" * 33, "c" * 80]
    got = {(i, j): r for i, j, r in V._tile_pairs(names, None, 90.0)}
    want = {(i, j): r for i in range(4) for j in range(i + 1, 4) if (r := V.indel_ratio(names[i], names[j])) >= 90}
    assert len(want) == 3 and got == pytest.approx(want)
    assert {(i, j): r for i, j, r in V._tile_pairs(names, names[::-1], 90.0)} == pytest.approx({(i, 3 - j): r for i, a in enumerate(names) for j, b in enumerate(names) if (r := V.indel_ratio(a, b)) >= 90})


def test_each_pair_of_blocks_meets_once_and_blocks_stay_small(spark):
    rows = spark.range(5000).select(F.col("id").alias("idx"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    work = flexibility._block_pairs(flexibility.as_vectors(rows), 700).select(F.transform("sides", lambda s: s["b"]).alias("b"), F.aggregate("sides", F.lit(0), lambda n, s: n + F.size(s["rows"])).alias("n"))
    assert "collect_list" not in work._jdf.queryExecution().executedPlan().toString()
    got = work.collect()
    assert sorted(tuple(sorted(r["b"])) for r in got) == sorted((i, j) if i < j else (i,) for i in range(8) for j in range(i, 8))
    assert sum(r["n"] for r in got) == 8 * 5000 and max(r["n"] for r in got) < 1600
    assert dict(rows.dtypes)["vector"] == dict(flexibility.as_vectors(rows).dtypes)["vector"] == "array<float>"


def test_dish_vectors_shuffle_no_vectors_and_agree_with_the_join(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 4000 END AS dish", "id * 31 % 45 AS ingredient", "CASE WHEN id % 11 <> 0 THEN CAST(id % 5 AS DOUBLE) END AS weight").unionAll(spark.sql("SELECT 5000L, 1L, CAST(NULL AS DOUBLE) UNION ALL SELECT 5001L, 2L, 0D UNION ALL SELECT 5002L, 99L, 1D"))
    vectors = spark.range(40).selectExpr("id AS ingredient", "array(cos(id), sin(id), id / 40D) AS vector")
    fast = manifold.dish_vectors(rows, vectors)
    assert "Generate" not in fast._jdf.queryExecution().executedPlan().toString()
    got = {r["dish"]: r["vector"] for r in fast.collect()}
    monkeypatch.setattr(manifold, "BROADCAST_NUMBERS", 0)
    want = {r["dish"]: r["vector"] for r in manifold.dish_vectors(rows, vectors).collect()}
    assert len(got) == fast.count() and set(got) == set(want) and None in got and 5002 not in got and got[5000] == got[5001] == [None] * 3
    for dish, v in want.items():
        assert got[dish] == (v if v[0] is None else pytest.approx(v))


def test_nearest_groups_are_those_of_all_distances_without_computing_them(monkeypatch):
    rng = np.random.default_rng(3)

    def block(first, n, scale):
        v = rng.integers(0, 3, (n, 5)) * scale + rng.choice([0.0, 1e6], (n, 1))
        return np.arange(first, first + n), rng.integers(1, 4, n).astype(float), v

    one, two = block(0, 90, 1.0), block(500, 70, 1e-3)
    whole = {k: linkage._distances(x[2], x[1], y[2], y[1]) for k, (x, y) in {"same": (one, one), "both": (one, two)}.items()}
    monkeypatch.setattr(linkage, "_distances", None)
    side = lambda x: {"rows": [{"rep": int(r), "size": int(n), "vector": v.tolist()} for r, n, v in zip(*x, strict=True)]}
    for key, sides in {"same": [one], "both": [one, two]}.items():
        got = pa.Table.from_batches(linkage._nearest(iter([pa.RecordBatch.from_pylist([{"sides": [side(x) for x in sides]}])]))).to_pylist()
        d, (i, j) = whole[key].copy(), (sides[0][0], sides[-1][0])
        d[i[:, None] == j[None]] = np.inf
        want = [min((d[r, c], min(i[r], j[c]), max(i[r], j[c]), i[r], j[c]) for c in range(len(j))) for r in range(len(i))]
        want += [min((d[r, c], min(i[r], j[c]), max(i[r], j[c]), j[c], i[r]) for r in range(len(i))) for c in range(len(j))] if len(sides) == 2 else []
        assert [(r["rep"], r["d"], r["mate"]) for r in got] == [(w[3], w[0], w[4]) for w in want]


def test_rules_of_two_neighbours_fit_without_the_text(spark):
    texts = {1: "a b c", 2: "b a c", 3: "c a b", 4: "a", 5: None, 6: "", 7: "b c a c", 8: "a c b d 12"}
    table = [(4, "drop", "ab", ["a b"], None), (2, "review", "bc", ["b c"], None), (2, "drop", "first of two", ["c a"], None), (9, "drop", "d", ["a c", "d"], "[0-9]"), (7, "drop", "again", ["a b"], None)]
    x = spark.createDataFrame(list(texts.items()), "k long, name string")
    r = spark.createDataFrame(table, "rule long, verdict string, reason string, words array<string>, pattern string")
    got = {z["k"]: z["reason"] for z in rules.judged(x, "k", "name", r).collect()}
    assert got == {1: "bc", 2: "default", 3: "first of two", 4: "default", 5: "default", 6: "default", 7: "first of two", 8: "d"}
    found = rules.first_rule(x, "k", "name", r.where("rule < 9")).select("k", "rule")
    sent = [line for line in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "HashAggregate" in line]
    assert sent and not any("name" in line or "collect" in line for line in sent) and found.count() == 3


def test_names_without_a_key_are_flagged_by_themselves_and_names_are_not_joined_back(spark):
    x = spark.createDataFrame([(1, "hot new"), (2, "hot soup new"), (3, "soup of hot"), (None, "ab"), (None, "hot new"), (4, "new of")], "k long, name string")
    words = spark.createDataFrame([("hot", "x"), ("new", "x"), ("soup", "?")], "word string, flag string")
    table = spark.createDataFrame([(1, "drop", "of", ["of hot"], None)], "rule long, verdict string, reason string, words array<string>, pattern string")
    out = rules.flagged(x, "k", "name", words, spark.createDataFrame([], "phrase string"), table)
    assert out.columns == ["k", "name", "flag"]
    assert sorted(((r["k"] or 0), r["name"], r["flag"]) for r in out.collect()) == [(0, "ab", "x"), (0, "hot new", ""), (1, "hot new", "x"), (2, "hot soup new", ""), (3, "soup of hot", "x"), (4, "new of", "")]


def test_recipes_with_common_counters_are_drawn_once_and_as_by_rows(spark, monkeypatch):
    ids = [r + 214_748 * m for r in (3, 4, 9, 214_747) for m in range(4)] + [-5, 1 << 31, (1 << 31) + 4]
    shapes = [(1.0, 2.0, 4.0), (3.0, 3.0, 3.0), (0.0, 0.0, 5.0), (-2.0, 1.0, 1.0), (0.5, 1.0, 2.0), (0.0, 0.0, 0.0)]
    rows = [(i, p, f"i{p % 3}", 10.0 * p + i % 7, *shapes[(i + p) % 6]) for i in ids for p in (1, 2, 2, 3)] + [(7, 1, "x", None, 1.0, 1.0, 1.0), (None, 1, "x", 1.0, 1.0, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "recipe_id long, position int, ingredient string, grams double, least double, mode double, most double")
    got = {r["recipe_id"]: r for r in montecarlo.simulated(x, 10_000).collect()}
    assert len(got) == len(set(ids)) + 2 and got[7]["mean"] is None and got[None]["mean"] is None
    some = x.where(F.col("recipe_id").isin(ids[1], ids[6], ids[13], *ids[-3:]))
    for r in montecarlo.summarised(montecarlo.draws(some, 10_000)).collect():
        assert [got[r["recipe_id"]][c] for c in r.asDict()] == pytest.approx(list(r), rel=1e-9)
    made, plain = [], montecarlo._Draws._made
    monkeypatch.setattr(montecarlo._Draws, "_made", lambda self, j, at, n: made.append(n) or plain(self, j, at, n))
    draws = montecarlo._Draws(10_000, 0.15)
    near = sorted((i * 10_000 % montecarlo.M, i) for i in range(0, 9_000_000) if i * 10_000 % montecarlo.M < 20_000)
    for at, i in near:
        montecarlo._recipe(draws, i, at, [{"position": 1, "ingredient": "a", "grams": 1.0, "least": 1.0, "mode": 2.0, "most": 4.0}], 5, True)
    assert len(near) > 80 and sum(made) <= 35_000


def test_parts_of_the_simulation_can_be_left_out(spark):
    x = spark.createDataFrame([(1, p, f"i{p}", 5.0 * p, 1.0, 2.0, 4.0) for p in range(1, 8)], "recipe_id long, position int, ingredient string, grams double, least double, mode double, most double")
    whole = montecarlo.simulated(x, 1_000).first()
    bare = montecarlo.simulated(x, 1_000, top=0).first()
    assert bare["drivers"] is None and bare["p95"] == whole["p95"] and bare["sd"] == whole["sd"]
    drivers = montecarlo.simulated(x, 1_000, percentiles=False).first()
    assert drivers["p95"] is None and drivers["drivers"] == whole["drivers"] and len(whole["drivers"]) == 5


def test_density_regions_over_many_tiles_are_the_plain_ones_in_few_jobs(spark):
    rng = np.random.default_rng(12)
    spots = [(0, 0, 2), (30, 5, 3), (33, 30, 1), (62, 10, 0.5), (70, 12, 0.6)]
    p = np.concatenate([rng.normal((x, y), s, (90, 2)) for x, y, s in spots] + [rng.uniform(-20, 100, (100, 2)), np.full((40, 2), 90.0), [[400.0, 400.0]]])
    p = np.round(p[rng.permutation(len(p))], 1)  # so that many ways are equal
    want = plain_regions(p, 12)
    x = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "idx long, x double, y double").repartition(3)
    spark.sparkContext.setJobGroup("regions", "")
    try:
        got = {r["idx"]: r["region"] for r in density.density_regions(x, 12, tile=100).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("regions"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[i] for i in range(len(p))] == want and max(want) >= 4 and 0 < jobs < 250
    assert density._safe([1, 2, 3], [(1.0, 1, 2), (2.0, 2, 3)], [(9.0, 1, 8, 4.0), (1.5, 2, 7, 4.0), (9.0, 3, 8, 1.0)]) == ({1: 1, 2: 1, 3: 3}, [(1.0, 1, 2)])
