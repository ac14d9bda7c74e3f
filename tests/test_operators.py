import numpy as np
import plain_linkage
import pytest
from pyspark.sql import functions as F

from platelab.operators import cleaning, flexibility, impact, manifold, montecarlo, nutrition, statistics
from platelab.operators import vocabulary as V


def aliases(spark, rows):
    return spark.createDataFrame(rows, "canonical_name string, alias_name string, alias_count long, cluster_id long, method string")


def test_indel_ratio():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 200 * t[-1][-1] / (len(a) + len(b)) if a or b else 100

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        assert V.indel_ratio(a, b) == pytest.approx(brute(a, b))


def test_fuzzy_clusters(spark):
    names = [("chicken pad thai", 50), ("chiken pad thai", 3), ("chicken pizza thai", 5), ("soup", 9), ("soop", 1), ("chicken pad tha", 1)]
    got = {r["alias_name"]: r for r in V.fuzzy_clusters(spark.createDataFrame(names, "name string, n long")).collect()}
    assert got["chiken pad thai"]["canonical_name"] == got["chicken pad tha"]["canonical_name"] == "chicken pad thai"
    assert got["chicken pizza thai"]["canonical_name"] == "chicken pizza thai" and got["soop"]["method"] == "self"
    assert got["chiken pad thai"]["cluster_id"] == got["chicken pad thai"]["cluster_id"] and got["chiken pad thai"]["method"] == "fuzzy"


def greedy_clusters(names, ratio=90.0):
    """The rule one name after another."""
    heads, out = [], {}
    for name, _ in sorted(names, key=lambda r: (-r[1], r[0])):
        scores = [(V.indel_ratio(h, name), -k) for k, h in enumerate(heads) if len(h.split()) == len(name.split())]
        best = max(scores, default=(0.0, 0))
        if best[0] >= ratio:
            out[name] = heads[-best[1]]
        else:
            heads.append(name)
            out[name] = name
    return out


def test_fuzzy_clusters_follow_the_sequential_rule(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(V, "TILE", 40)
    base = ["".join(rng.choice(list("abcdeé "), rng.integers(5, 30))) for _ in range(40)] + ["".join(rng.choice(list("abcde "), 150)) for _ in range(6)]
    names = {}
    for b in base:
        for _ in range(8):
            x = list(b)
            for _ in range(rng.integers(0, max(2, len(x) // 8))):
                x[rng.integers(0, len(x))] = rng.choice(list("abcde"))
            name = " ".join("".join(x).split())
            if name:
                names[name] = int(rng.integers(1, 20))
    got = {r["alias_name"]: r["canonical_name"] for r in V.fuzzy_clusters(spark.createDataFrame(list(names.items()), "name string, n long").repartition(3)).collect()}
    want = greedy_clusters(list(names.items()))
    assert got == want and len(set(want.values())) < len(want)


def test_policies(spark):
    a = aliases(spark, [("w ham", "w ham", 3, 1, "self"), ("w ham", "w hamm", 1, 1, "fuzzy"), ("ham", "ham", 9, 2, "self"), ("b egg roll", "b egg roll", 2, 3, "self"), ("x", "x", 1, 4, "self")])
    d = V.cleaned_decisions(V.summary(a), V.without_single_letters(F.col("canonical_name")))
    assert {(r["cluster_id"], r["action"]) for r in d.collect()} == {(1, "merge"), (3, "rename"), (4, "drop")}
    got = {tuple(r) for r in V.apply_decisions(a, d, "replace_self", "m").collect()}
    assert got == {("ham", "w ham", 3, 2, "m"), ("ham", "w hamm", 1, 2, "fuzzy"), ("ham", "ham", 9, 2, "self"), ("egg roll", "egg roll", 2, 3, "self")}
    kept = {tuple(r) for r in V.apply_decisions(a, d, "preserve_self", "m").where("cluster_id = 3").collect()}
    assert kept == {("egg roll", "egg roll", 0, 3, "self"), ("egg roll", "b egg roll", 2, 3, "rename_preserved")}


def test_merges_follow_one_step(spark):
    a = aliases(spark, [(n, n, 1, i, "self") for i, n in enumerate("abcd")])
    d = spark.createDataFrame([(0, "merge", 1, None), (1, "merge", 2, None), (2, "merge", 3, None)], "cluster_id long, action string, target_id long, new_name string")
    got = {r["alias_name"]: r["cluster_id"] for r in V.apply_decisions(a, d, "all_rows", "llm_merge").collect()}
    assert got == {"a": 2, "b": 3, "c": 3, "d": 3}


def test_one_self(spark):
    a = aliases(spark, [("a", "a", 1, 1, "fuzzy"), ("a", "b", 5, 1, "fuzzy"), ("c", "c", 1, 2, "self"), ("c", "d", 2, 2, "self")])
    got = V.one_self(a).where("method = 'self'").collect()
    assert {(r["cluster_id"], r["alias_name"]) for r in got} == {(1, "b"), (2, "c")}


def test_overlay_and_proposals(spark):
    layer = lambda rows: spark.createDataFrame(rows, "cluster_id long, action string, target_id long, new_name string")
    got = V.overlay(layer([(1, "merge", 2, None), (3, "drop", None, None)]), layer([(1, "keep", None, None), (3, "rename", None, "z")])).collect()
    assert [(r["cluster_id"], r["action"], r["new_name"]) for r in got] == [(3, "rename", "z")]
    clusters = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cluster_id long, canonical_name string")
    p = [(1, "Merge", 2, None, "High", 1), (1, "merge", 3, None, "low", 2), (2, "merge", 2, None, "x", 3), (9, "merge", 2, None, "x", 4), (3, "rename", None, "b", "m", 5), (2, "explode", 1, None, "x", 6)]
    good, bad = V.validate_proposals(spark.createDataFrame(p, "source_cid long, action string, target_cid long, new_canonical string, confidence string, priority int"), clusters)
    assert {(r["source_cid"], r["bucket"]) for r in good.collect()} == {(1, "high"), (3, "medium")} and bad.count() == 4
    assert {(r["cluster_id"], r["action"], r["target_id"]) for r in V.resolve_proposals(good, clusters).collect()} == {(1, "merge", 2), (3, "merge", 2)}


def test_replies(spark):
    batches = spark.createDataFrame([(1, "1. YES - same dish\n2) no\nnonsense\n4: KEEP fine")], "batch int, reply string")
    items = spark.createDataFrame([(1, i) for i in range(1, 5)], "batch int, item int")
    got = {r["item"]: (r["verdict"], r["reason"]) for r in V.parse_replies(batches, items).collect()}
    assert got == {1: ("YES", "same dish"), 2: ("NO", ""), 3: ("PARSE_ERROR", None), 4: ("KEEP", "fine")}


def test_chunks_and_shards(spark):
    x = spark.range(10).toDF("k")
    assert [r["chunk"] for r in cleaning.equal_chunks(x, [F.col("k")], 4).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r["shard"] for r in cleaning.shard(x, [F.col("k")], 3).orderBy("k").collect()] == [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]


def test_monte_carlo_moments(spark):
    rows = spark.createDataFrame([(1, 0, "a", 100.0, 1.0, 2.0, 6.0), (2, 0, "b", 50.0, 2.0, 2.0, 2.0)], "recipe_id long, position int, ingredient string, grams double, least double, mode double, most double")
    d = montecarlo.draws(rows, 10_000)
    got = {r["recipe_id"]: r for r in montecarlo.summarised(d).collect()}
    assert got[1]["mean"] == pytest.approx(300, rel=0.02) and got[2]["mean"] == pytest.approx(100, rel=0.02) and got[2]["sd"] == pytest.approx(15, rel=0.06)
    assert sorted((r["recipe_id"], round(r["share"], 6)) for r in montecarlo.variance_drivers(d).collect()) == [(1, 1.0), (2, 1.0)]
    assert d.exceptAll(montecarlo.draws(rows.repartition(7), 10_000)).count() == 0


def test_widening(spark):
    x = spark.range(1).select(impact.widened(F.lit(4.84), F.lit(4.0), F.lit(9.3), F.array(F.lit(0.1), F.lit(3.39), F.lit(99.0))).alias("w")).first()["w"]
    assert (x["least"], x["most"]) == (3.388, 9.3)


def test_curve_invariants(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    dishes = spark.createDataFrame([(i, x.tolist(), float(rng.uniform(1, 9))) for i, x in enumerate(v)], "idx long, vector array<double>, ghg double")
    pairs = flexibility.pairs_within(dishes, 0.9, block=16)
    want = {(i, j) for i in range(60) for j in range(60) if i == j or 1 - v[i] @ v[j] <= 0.9}
    assert {(r["i"], r["j"]) for r in pairs.collect()} == want and pairs.count() == len(want)
    metrics = dishes.select("idx", "ghg", F.when(F.col("idx") % 7 != 0, F.col("idx") % 11).cast("double").alias("health"))
    value = lambda v: None if v is None else round(v, 9)
    both = [{tuple(map(value, r)) for r in x.select("idx", "radius", "neighbors", "ghg", "health").collect()} for x in (flexibility.improvements(pairs, metrics, ["ghg"], ["health"], (0.0, 0.4, 0.9)), flexibility.best_gains(dishes, metrics, ["ghg"], ["health"], (0.0, 0.4, 0.9), block=16))]
    assert both[0] == both[1]
    c = flexibility.curve(flexibility.improvements(pairs, dishes.select("idx", "ghg"), ["ghg"], [], (0.0, 0.4, 0.9)), ["ghg"]).orderBy("radius").collect()
    assert c[0]["ghg_mean"] == 0 and c[0]["mean_neighbors"] == 1 and c[0]["ghg_mean"] <= c[1]["ghg_mean"] <= c[2]["ghg_mean"]


def test_weighted_quantiles_are_those_of_interpolation(spark):
    rng = np.random.default_rng(3)
    v, w = rng.uniform(0, 10, 50), rng.uniform(1, 5, 50)
    got = statistics.weighted_quantiles(spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(v, w, strict=True)], "g string, v double, w double"), ["g"], "v", "w", (0.0, 0.1, 0.5, 0.95, 1.0)).first()
    o = np.argsort(v)
    c = (np.cumsum(w[o]) - w[o] / 2) / w.sum()
    assert [got[f"q{q:02d}"] for q in (0, 10, 50, 95, 100)] == pytest.approx(np.interp([0, 0.1, 0.5, 0.95, 1], c, v[o]).tolist())


def test_ward_tree():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.1, (8, 2)) for m in (0, 5, 10)])
    merges = plain_linkage.ward_tree(x)
    assert len(merges) == 23 and merges[-1][3] == 24
    cut = plain_linkage.cut_tree(merges, 24, 3)
    assert [cut[i * 8 : i * 8 + 8] for i in range(3)] == [[0] * 8, [1] * 8, [2] * 8]
    assert plain_linkage.average_linkage(np.array([[0, 0], [1, 0], [50, 0]]), 10) == [0, 0, 1]
    assert plain_linkage.unique_names([(1, ["a", "b"]), (9, ["a"])]) == ["b", "a"]


def test_smoothing_keeps_the_mass(spark):
    grid = spark.createDataFrame([(300, 300, 10.0)], "cx int, cy int, weight double")
    assert manifold.smoothed_grid(grid).agg(F.sum("weight")).first()[0] == pytest.approx(10, rel=0.01)


def test_cross_source_finds_words_within_words(spark):
    items = spark.createDataFrame([(1, "Pineapple (1)"), (2, "coconut oil"), (3, "nut"), (4, "x2y z")], "item int, name string")
    products = spark.createDataFrame([(1, "apple", 1.0), (2, "nut", 2.0), (3, "Oils", 3.0), (4, "rice", 4.0), (5, "hazelnut", 5.0)], "product_id int, name string, value double")
    got = {(r["item"], r["name"], r["value"]) for r in impact.cross_source(items, products).collect()}
    assert got == {(1, "apple", 1.0), (2, "nut", 2.0), (2, "Oils", 3.0), (3, "nut", 2.0), (3, "hazelnut", 5.0)}


def test_swaps_cut_more_than_a_tenth(spark):
    v = {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0], 4: [0.8, 0.6]}
    vectors = spark.createDataFrame(list(v.items()), "idx long, vector array<double>")
    dishes = spark.createDataFrame([(1, "a", 10.0, 1.0), (2, "a", 9.5, 5.0), (3, "b", 5.0, 1.0), (4, "b", float("nan"), 9.0)], "idx long, cuisine string, ghg double, health double")
    assert [(r["idx"], r["swap"]) for r in flexibility.swap_search(vectors, dishes).collect()] == [(1, 3)]


def test_cooked_food_counts_at_its_weight_before(spark):
    rows = spark.createDataFrame([(1, "Beef", 400.0), (2, "beef raw", 400.0), (3, "rice", 100.0), (3, "beans", 100.0), (4, "beans", 0.05)], "recipe_id long, ingredient string, grams double")
    groups = spark.createDataFrame([("beef", "red_meat", "Beef, GRILLED"), ("beef raw", "red_meat", "Beef, raw"), ("rice", "whole_grains", "Rice, cooked"), ("beans", "legumes", "Beans, boiled")], "ingredient string, group string, description string")
    got = {r["recipe_id"]: {k: round(v, 3) for k, v in r["group_grams"].items()} for r in nutrition.meal_groups(rows, groups, 4.0).collect()}
    assert got == {1: {"red_meat": 142.857}, 2: {"red_meat": 100.0}, 3: {"whole_grains": 11.25, "legumes": 10.0}}
    assert {r["recipe_id"] for r in nutrition.meal_groups(rows, groups, F.lit(0.0)).collect()} == {1, 2, 3}


def test_ingredients_without_a_food_go_by_name(spark):
    rows = spark.createDataFrame([(1, "Ground beef, grilled", 80.0), (1, "salt", 5.0), (1, "black beans", 40.0), (2, "pork bacon", 20.0), (2, "rice", 100.0)], "recipe_id long, ingredient string, grams double")
    groups = spark.createDataFrame([("rice", "whole_grains", "Rice, cooked")], "ingredient string, group string, description string")
    got = {r["recipe_id"]: r["group_grams"] for r in nutrition.meal_groups(rows, groups, 4.0).collect()}
    assert got == {1: {"red_meat": 20.0, "legumes": 10.0}, 2: {"processed_meat": 5.0, "whole_grains": 11.25}}
