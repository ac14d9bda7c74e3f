"""Operators that work in ranges, blocks and rounds, against plain computation."""

import numpy as np
import plain_linkage
import pytest

from pyspark.sql import functions as F

from platelab.operators import density, flexibility, graphs, linkage, manifold, ordering, rules, statistics


def quantiles(v, w, shares):
    o = np.lexsort((w, v))
    v, w = v[o], w[o]
    return np.interp(shares, (np.cumsum(w) - w / 2) / w.sum(), v)


def test_quantiles_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    n = 6000
    g = rng.choice(["a", "b", "c", None], n, p=[0.8, 0.15, 0.049, 0.001])
    v, w = np.round(rng.lognormal(2, 1, n), 1), rng.uniform(0.1, 4, n)
    v[: n // 3] = 7.5
    rows = [(x if x is None else str(x), float(a), float(b)) for x, a, b in zip(g, v, w)] + [("a", None, 1.0), ("a", 1e9, 0.0), ("one", 3.0, 2.0)]
    shares = (0.0, 0.01, 0.25, 0.33, 0.5, 0.9, 1.0)
    x = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {r["g"]: [r[f"q{round(s * 100):02d}"] for s in shares] for r in statistics.weighted_quantiles(x, ["g"], "v", "w", shares).collect()}
    for name in ("a", "b", "c"):
        assert got[name] == pytest.approx(quantiles(v[g == name], w[g == name], shares).tolist())
    none = np.array([x is None for x in g])
    assert got[None] == pytest.approx(quantiles(v[none], w[none], shares).tolist()) and got["one"] == [3.0] * 7
    whole = statistics.weighted_quantiles(x.where("v is not null and v < 1e9 and g <> 'one' or g is null"), [], "v", "w", shares).first()
    assert list(whole) == pytest.approx(quantiles(v, w, shares).tolist())
    assert statistics.weighted_quantiles(x.where("v < -1"), ["g"], "v", "w", shares).count() == 0


def test_no_window_over_a_group(spark):
    x = spark.range(100).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v", "1.0D AS w")
    plan = statistics.weighted_quantiles(x, ["g"], "v", "w", (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("range" in line for line in windows)


def test_ranks_with_ties_over_range_borders(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(900, 5.0), rng.integers(0, 12, 1100).astype(float)])
    rng.shuffle(values)
    rows = [(int(i), "p" if i % 3 else "q", float(v) if i % 50 else None) for i, v in enumerate(values)]
    x = spark.createDataFrame(rows, "k long, g string, v double").repartition(7)
    got = {r["k"]: (r["place"], r["rank"], r["n"]) for r in ordering.ranked(x, ["g"], F.col("v"), F.col("k")).collect()}
    for g in ("p", "q"):
        held = sorted(((r[2] is not None, r[2] or 0, r[0]) for r in rows if r[1] == g))
        for place, (known, v, k) in enumerate(held):
            assert got[k] == (place + 1, 1 + sum((a, b) < (known, v) for a, b, _ in held), len(held))
    shares = {r["k"]: r["share"] for r in manifold.rank_share(x, "v").collect()}
    known = [r[2] for r in rows if r[2] is not None]
    assert all(shares[k] == (None if v is None else pytest.approx(sum(u < v for u in known) / len(known))) for k, _, v in rows)


def test_spearman(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 800), rng.integers(0, 9, 800)
    x = spark.createDataFrame([(i, float(p), float(q), float(1 + i % 4)) for i, (p, q) in enumerate(zip(a, b))], "k long, a double, b double, w double")
    ra, rb = np.argsort(np.argsort(a, kind="stable"), kind="stable"), np.argsort(np.argsort(b, kind="stable"), kind="stable")
    assert statistics.spearman_matrix(x, ["a", "b"], "k").first()["rho"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert statistics.weighted_spearman(x, "a", "b", "w", "k").first()["rho"] == pytest.approx(np.cov(ra, rb, aweights=1 + np.arange(800) % 4)[0, 1] / np.sqrt(np.cov(ra, aweights=1 + np.arange(800) % 4) * np.cov(rb, aweights=1 + np.arange(800) % 4)))


@pytest.fixture(scope="module")
def clustered(spark):
    """Unit vectors in ten clusters, and a table of their dishes."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((10, 12))[rng.integers(0, 10, 300)] + 0.25 * rng.standard_normal((300, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ghg, health = np.round(rng.uniform(1, 9, 300), 1), rng.integers(0, 5, 300).astype(float)
    health[::17] = np.nan
    cuisine = rng.choice(["x", "y", "z", None], 300)
    shares = rng.dirichlet([2, 2, 2], 300) * 100
    rows = [(i, p.tolist(), None if i % 41 == 0 else float(g), float(h), None if c is None else str(c), (float(s[0]), float(s[1]), float(s[2]))) for i, (p, g, h, c, s) in enumerate(zip(v, ghg, health, cuisine, shares))]
    x = spark.createDataFrame(rows, "idx long, vector array<double>, ghg double, health double, cuisine string, shares struct<protein:double,fat:double,carb:double>")
    d = np.maximum(0, 1 - v @ v.T)
    np.fill_diagonal(d, 0)
    return x.repartition(4).cache(), rows, d


def test_constrained_neighbours(clustered):
    x, rows, d = clustered
    known = lambda z: z is not None and not np.isnan(z)
    swap, pick, ratios, sweep = {}, {}, [], {t: [] for t in (0.0, 10.0, 30.0, 100.0)}
    for i, (_, _, gi, hi, ci, si) in enumerate(rows):
        near = [rows[j] for j in range(300) if d[i, j] <= 0.2]
        options = []
        for j, _, g, h, c, s in near:
            if j != i and known(g) and known(h) and known(gi) and known(hi) and g < 0.9 * gi and h >= hi:
                options.append((c != ci, -round((gi - g) / gi + 2 * (h - hi), 9), j))
        if options:
            swap[i] = min(options)[2]
        with_ghg = [(r[2], r[0], r[3]) for r in near if known(r[2])]
        with_health = [(-r[3], r[0], r[2]) for r in near if known(r[3])]
        if with_ghg:
            pick[i] = min(with_ghg)[1]
        if known(gi):
            for t in sweep:
                fit = [r[2] for r in near if known(r[2]) and (r[0] == i or sum(abs(p - q) for p, q in zip(si, r[5])) / 2 <= t)]
                sweep[t].append((gi - min(fit)) / gi)
        win = any(known(r[2]) and known(gi) and r[2] < gi and known(r[3]) and known(hi) and r[3] > hi for r in near)
        both = (min(with_ghg), min(with_health)) if with_ghg and with_health else None
        ratios.append((both and known(both[0][2]) and known(hi) and both[0][2] > hi, both and known(both[1][2]) and known(gi) and both[1][2] < gi, win, both is not None))
    assert len(swap) > 50 and max(len([j for j in range(300) if d[i, j] <= 0.2]) for i in range(300)) > 20
    for block in (64, 2048):
        v = x.select("idx", "vector")
        assert {r["idx"]: r["swap"] for r in flexibility.swap_search(v, x, 0.2, block).collect()} == swap
        assert {r["idx"]: r["pick"] for r in flexibility.best_pick(v, x, "ghg", 0.2, True, block).collect()} == pick
        got = {r["tolerance"]: r["mean_gain"] for r in flexibility.tolerance_sweep(v, x, "ghg", list(sweep), 0.2, block).collect()}
        assert got == pytest.approx({t: float(np.mean(g)) for t, g in sweep.items()})
        one = flexibility.co_benefits(v, x.withColumn("health", F.nanvl("health", F.lit(None).cast("double"))), 0.2, block).first()
        asked = [r for r in ratios if r[3]]
        assert list(one) == pytest.approx([np.mean([bool(r[0]) for r in asked]), np.mean([bool(r[1]) for r in asked]), np.mean([r[2] for r in ratios])])


def test_ward_tree_of_two_thousand_points(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((40, 6))[rng.integers(0, 40, 2000)] * 3 + rng.standard_normal((2000, 6))
    ids = rng.permutation(5000)[:2000]
    v = v[np.argsort(ids)]
    ids = np.sort(ids)
    merges = plain_linkage.ward_tree(v)
    order = sorted(range(1999), key=lambda k: merges[k][2])
    new = {2000 + k: 2000 + at for at, k in enumerate(order)}
    want = [(at, *sorted(new.get(x, x) for x in merges[k][:2]), merges[k][3]) for at, k in enumerate(order)]
    points = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, v)], "idx long, vector array<double>").repartition(4)
    tree = linkage.ward_tree(points, block=400)
    got = sorted(tree.collect())
    assert [(r["step"], r["a"], r["b"], r["size"]) for r in got] == want
    assert [r["height"] for r in got] == pytest.approx([merges[k][2] for k in order])
    cuts = {}
    for r in linkage.clades(tree, (1, 24, 150, 800, 2000)).collect():
        cuts.setdefault(r["cut"], {})[r["leaf"]] = r["clade"]
    for k in (1, 24, 150, 800, 2000):
        assert [cuts[k][i] for i in range(2000)] == plain_linkage.cut_tree(merges, 2000, k)


def test_ward_tree_with_copies(spark):
    points = [(i, [float(i // 4), 0.0]) for i in range(40)] + [(100, [50.0, 0.0])]
    x = spark.createDataFrame(points, "idx long, vector array<double>")
    a, b = (sorted(map(tuple, linkage.ward_tree(x, block).collect())) for block in (8, 100))
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b]) and a[29][3] == 0 and a[-1][4] == 41
    assert all(r[3] <= s[3] for r, s in zip(a, a[1:])) and sorted(c for r in a for c in r[1:3]) == list(range(80))
    got = {r["leaf"]: r["clade"] for r in linkage.clades(linkage.ward_tree(x, 8), [11]).collect()}
    assert [got[i] for i in range(41)] == [i // 4 for i in range(40)] + [10]
    assert linkage.ward_tree(x.where("idx < 0")).count() == 0 and linkage.ward_tree(x.where("idx = 1")).count() == 0


def test_regions_of_average_linkage(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0, 1000, (500, 2))
    want = plain_linkage.average_linkage(p, 85.0)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "idx long, vector array<double>").repartition(3)
    got = {r["idx"]: r["region"] for r in linkage.average_linkage(x, 85.0, block=128).collect()}
    groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == k).tolist()) for k in set(labels)}
    assert groups([got[i] for i in range(500)]) == groups(want) and all(got[i] <= i for i in got)


def test_names_are_given_once(spark):
    rng = np.random.default_rng(7)
    wishes = [(i, float(rng.integers(1, 60)), [f"n{k}" for k in rng.integers(0, 40, rng.integers(0, 9))]) for i in range(80)]
    got = {r["region"]: r["name"] for r in linkage.unique_names(spark.createDataFrame(wishes, "region long, area double, names array<string>")).collect()}
    want = plain_linkage.unique_names([(a, w) for _, a, w in wishes])
    assert got == dict(enumerate(want)) and None in want


def test_components_and_semantic_merge(spark):
    rng = np.random.default_rng(8)
    n = 700
    v = rng.standard_normal((60, 16))[rng.integers(0, 60, n)] + 0.28 * rng.standard_normal((n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    key = rng.choice(["a", "b", "c", "d"], n, p=[0.55, 0.25, 0.15, 0.05])
    count = rng.integers(1, 50, n)
    rows = [(int(i), str(k), int(c), p.tolist()) for i, (k, c, p) in enumerate(zip(key, count, v))] + [(900, None, 1, [0.0] * 16), (901, "a", 1, None)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.86, 1) & (key[:, None] == key))):
        parent[find(int(j))] = find(int(i))
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(i)
    want = {i: (min(m, key=lambda x: (-count[x], x)), len(m)) for m in members.values() for i in m} | {900: (900, 1), 901: (901, 1)}
    assert 20 < len(members) < n - 50
    x = spark.createDataFrame(rows, "idx long, key string, count long, vector array<double>").repartition(3)
    for block in (50, 2048):
        assert {r["idx"]: (r["root"], r["members"]) for r in graphs.semantic_merge(x, 0.86, block).collect()} == want
    links = graphs.similar_vectors(x.where("key is not null and vector is not null"), 0.86, 50).count()
    assert links < 8 * n
    chain = spark.range(60).selectExpr("id AS u", "id + 1 AS v")
    assert {r["root"] for r in graphs.connected_components(chain).collect()} == {0}


def test_rules_from_a_table(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(60)]
    names = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for i in range(400)] + [(400, None), (401, "number 12"), (402, "9000")]
    table = [(10 * k + 5, ["drop", "review"][k % 2], f"r{k}", [a, b], f"(^| ){a} ({b}|x)( |$)") for k, (a, b) in enumerate(rng.choice(vocabulary, (500, 2)).tolist())]
    table += [(3, "drop", "pair", ["w1", "w2"], None), (7000, "review", "digits", [], "[0-9]{4}"), (7001, "drop", "number", None, "^number"), (1, "drop", "never", ["absent"], None)]
    r = spark.createDataFrame(table, "rule long, verdict string, reason string, words array<string>, pattern string")
    x = spark.createDataFrame(names, "k long, name string")
    import re

    def plain(text):
        held = set((text or "").split())
        for rule, verdict, reason, words, pattern in sorted(table, key=lambda t: t[0]):
            if text is not None and set(words or []) <= held and (pattern is None or re.search(pattern, text)):
                return verdict, reason
        return "keep", "default"

    got = rules.judged(x, "k", "name", r)
    assert {z["k"]: (z["verdict"], z["reason"]) for z in got.collect()} == {k: plain(t) for k, t in names}
    size = lambda rows: len(rules.judged(x, "k", "name", rows)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(r) == size(r.where("rule < 50 or rule >= 7000"))
    with pytest.raises(ValueError):
        rules.first_rule(x, "k", "name", spark.range(70).selectExpr("id AS rule", "'drop' AS verdict", "'r' AS reason", "CAST(array() AS array<string>) AS words", "'x' AS pattern"))


def test_flags_from_tables(spark):
    names = {1: "hot", 2: "sub", 3: "ab", 4: "12", 5: "", 6: None, 7: "hot new", 8: "hot soup", 9: "pick your bowl", 10: "of the day", 11: "soup 3 for 1", 12: "soup"}
    x = spark.createDataFrame(list(names.items()), "k long, name string")
    words = spark.createDataFrame([("hot", "x"), ("new", "x"), ("sub", "?")], "word string, flag string")
    table = spark.createDataFrame([(1, "drop", "deal", ["for"], "[0-9] for [0-9]")], "rule long, verdict string, reason string, words array<string>, pattern string")
    got = {r["k"]: r["flag"] for r in rules.flagged(x, "k", "name", words, spark.createDataFrame([("of the day",)], "phrase string"), table).collect()}
    assert got == {1: "x", 2: "?", 3: "x", 4: "", 5: "x", 6: "x", 7: "x", 8: "", 9: "x", 10: "x", 11: "x", 12: ""}


def plain_regions(p, least):
    """Density regions by the textbook: all distances, edges by length, a tree that is condensed and judged."""
    n = len(p)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, reach[i, j]))
    parent, tree, held = list(range(2 * n)), {}, {k: [k] for k in range(n)}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    node = n
    for k in order:
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            parent[a] = parent[b] = node
            tree[node] = (a, b, float(reach[i[k], j[k]]))
            held[node] = held[a] + held[b]
            node += 1
            if node == 2 * n - 1:
                break
    stable, parts, under, born = {}, {}, {}, {}
    stack = [(2 * n - 2, 2 * n - 2)]
    born[2 * n - 2] = 0.0
    stable[2 * n - 2], parts[2 * n - 2], under[2 * n - 2] = 0.0, [], []
    while stack:
        at, cluster = stack.pop()
        a, b, length = tree[at]
        dense = 1 / max(length, 1e-12)
        large = [c for c in (a, b) if len(held[c]) >= least]
        for c in (a, b):
            stable[cluster] += len(held[c]) * (dense - born[cluster]) if c not in large or len(large) == 2 else 0.0
            if c not in large:
                under[cluster] += held[c]
        if len(large) == 2:
            for c in large:
                born[c], stable[c], parts[c], under[c] = dense, 0.0, [], []
                parts[cluster].append(c)
                stack.append((c, c))
        elif large:
            stack.append((large[0], cluster))

    def best(c):
        inside = [best(x) for x in parts[c]]
        total = sum(x[0] for x in inside)
        if c != 2 * n - 2 and (not inside or stable[c] >= total):
            return stable[c], [c]
        return total, [y for x in inside for y in x[1]]

    def below(c):
        return under[c] + [x for k in parts[c] for x in below(k)]

    labels = np.full(n, -1)
    for c in best(2 * n - 2)[1]:
        labels[below(c)] = min(below(c))
    names = {m: k for k, m in enumerate(sorted(set(labels) - {-1}))}
    return [names.get(x, -1) for x in labels]


def test_density_regions(spark):
    rng = np.random.default_rng(10)
    spots = [(0, 0, 2), (30, 5, 3), (33, 30, 1), (60, 60, 6), (62, 10, 0.5), (70, 12, 0.6)]
    p = np.concatenate([rng.normal((x, y), s, (140, 2)) for x, y, s in spots] + [rng.uniform(-20, 100, (140, 2)), np.full((20, 2), 90.0)])
    p = p[rng.permutation(len(p))]
    want = plain_regions(p, 15)
    assert len(p) == 1000 and max(want) >= 5 and 50 < want.count(-1) < 400
    x = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "idx long, x double, y double").repartition(3)
    got = {r["idx"]: r["region"] for r in density.density_regions(x, 15).collect()}
    assert [got[i] for i in range(1000)] == want


def test_density_regions_of_few_points(spark):
    x = spark.range(10).selectExpr("id AS idx", "CAST(id AS DOUBLE) AS x", "0.0D AS y")
    assert {r["region"] for r in density.density_regions(x, 60).collect()} == {-1}
    assert density.density_regions(x.where("idx < 0"), 60).count() == 0
