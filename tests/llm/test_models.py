import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from platelab.llm import gru, kmeans_tree, knn_quality, recurrent_lm, token_counts


def greedy(word, pieces, longest):
    symbols, n, i = [*word, token_counts.END], 0, 0
    while i < len(symbols):
        for j in range(min(len(symbols), i + longest), i, -1):
            part = tuple(symbols[i:j])
            if part == (token_counts.END,) or part in pieces:
                n += part != (token_counts.END,)
                i = j
                break
        else:
            return 0
    return n


def test_automaton_matches_greedy_splitting():
    rng = random.Random(5)
    for _ in range(200):
        pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + (token_counts.END,) * rng.randint(0, 1) for _ in range(rng.randint(1, 14))}
        lengths = token_counts.Automaton(list(pieces))
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
            assert lengths[word] == greedy(word, pieces, 9), (pieces, word)


def test_token_counts(docs, rows, no_docs):
    pieces = set(token_counts.pieces_of())
    longest = max(map(len, pieces))
    got = sorted(tuple(-1 if x is None else x for x in r) for r in token_counts.token_counts(docs).collect())
    want = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = [greedy(w, pieces, longest) for w in words]
        want.append((-1 if r[0] is None else r[0], len(words), sum(n) + n.count(0), n.count(0)))
    assert got == sorted(want)
    assert token_counts.token_counts(no_docs).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shapes = gru.sizes(10, 6, 2, 4)
    flat = gru.new_params(shapes, np.ones(6) / 6, np.ones((2, 4)) / 4).astype(np.float64) * 2
    lengths = np.array([5, 3, 7, 2])
    lanes, n = gru.Lanes(lengths, 2), lengths.sum()
    keep = np.ones(n)
    keep[np.cumsum(lengths) - lengths] = 0
    inputs, classes, words, keep = (x[lanes.order] for x in (rng.integers(0, 10, n), rng.integers(0, 6, n), rng.integers(0, 4, n), keep))
    work = gru.Work(n, np.float64)
    blank = lambda: np.zeros((lanes.lanes, gru.HIDDEN))

    def loss(values):
        p = gru.views(values, shapes)
        return -gru.log_probabilities(p, work, gru.run(p, work, lanes, 0, lanes.steps, inputs, keep, blank()), classes, words).sum()

    total = np.zeros_like(flat)
    assert gru.gradients(gru.views(flat, shapes), gru.views(total, shapes), work, lanes, 0, lanes.steps, inputs, keep, classes, words, blank()) == pytest.approx(loss(flat))
    for part in gru.views(np.arange(len(flat)), shapes).values():
        at = part.ravel()[np.abs(total[part.ravel()]).argmax()]
        moved = [flat.copy(), flat.copy()]
        moved[0][at] += 1e-4
        moved[1][at] -= 1e-4
        assert total[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-4, rel=1e-3)


def test_lanes_hold_every_token_once_and_in_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 30, rng.integers(1, 40))
        lanes = gru.Lanes(lengths, 7)
        assert sorted(lanes.order.tolist()) == list(range(lengths.sum()))
        position = np.empty(lengths.sum(), np.int64)
        position[lanes.order] = np.arange(lengths.sum())
        step = np.searchsorted(lanes.at, position, "right") - 1
        lane = position - lanes.at[step]
        top = 0
        for n in lengths:
            assert len(set(lane[top : top + n])) == 1 and (np.diff(step[top : top + n]) == 1).all()
            top += n


@pytest.mark.parametrize("known", [recurrent_lm.KNOWN, 50])
def test_recurrent_lm(docs, rows, known, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "KNOWN", known)
    got = recurrent_lm.score(docs).collect()
    assert len(got) == len(rows)
    counts = Counter()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    tokens = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    for r, t in zip(rows, tokens, strict=True):
        if fold(r[0]):
            counts.update(t)
    total, different = sum(counts.values()), len(counts)
    want = []
    for r, t in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in t)
        want.append((-1 if r[0] is None else r[0], fold(r[0]) == 0, len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)


def test_recurrent_lm_learns_what_comes_next(spark):
    rng = random.Random(6)
    follow = {w: rng.sample([f"w{k}" for k in range(40)], 2) for w in (f"w{k}" for k in range(40))}
    texts = []
    for i in range(1500):
        words = ["w0"]
        for _ in range(100):
            words.append(rng.choice(follow[words[-1]]))
        texts.append((i, " ".join(words)))
    held = recurrent_lm.score(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert held["s"] > 0.75 * held["b"], held


def plain_steps(params, codes):
    """Probabilities of all classes, and of the words of a head class, before each token, one token at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(x))  # noqa: E731  gates fall as x grows
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = {k: v.astype(float) for k, v in params.items()}
    h, before = np.zeros(gru.HIDDEN), 0
    for code in codes:
        x = p["inputs"][before]
        z, r = np.split(sigmoid(x @ p["given_gates"] + h @ p["turn_gates"]), 2)
        new = np.tanh(x @ p["given_new"] + r * (h @ p["turn_new"]))
        h = z * h + (1 - z) * new
        one = np.append(h, 1)
        yield softmax(one @ p["classes"]), lambda c, one=one: softmax(one @ p["words"][c])
        before = code


@pytest.mark.parametrize("known", [recurrent_lm.KNOWN, 50])
def test_recurrent_lm_scores_like_a_plain_loop(docs, known, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "KNOWN", known)
    codes, counts, vocabulary = recurrent_lm.encoded(docs)
    values = recurrent_lm.trained(codes, vocabulary)
    params = gru.views(values, recurrent_lm.SHAPES)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["score"]) for r in recurrent_lm.scored(codes, counts, vocabulary, values).collect())
    found = Counter()
    for r in counts.collect():
        found.update(dict(zip(bytes(r["words"]).split(), np.frombuffer(bytes(r["n"]), "<i8").tolist(), strict=True)))
    width, head = recurrent_lm.WORDS_EACH, recurrent_lm.HEADS * recurrent_lm.WORDS_EACH
    assert len(found) > head  # so that there are rare words
    heads = {w: k + 1 for k, w in enumerate(vocabulary.words[: head - 1])}
    mass = np.full(recurrent_lm.ENDINGS, 0.1)  # of each ending's words that are no head words, and of one place for new ones
    for w, n in found.items():
        if w not in heads:
            mass[recurrent_lm.ending(w)] += n + 0.1
    want = []
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        code = [heads.get(w, head + recurrent_lm.ending(w)) for w in words] + [0]
        score = 0.0
        for w, c, (classes, inside) in zip([*words, None], code, plain_steps(params, code), strict=True):
            score += math.log10(classes[c // width] * inside(c // width)[c % width] if c < head else classes[recurrent_lm.HEADS + c - head] * (found[w] + 0.1) / mass[c - head])
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(code), score))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-3)


def test_recurrent_lm_probabilities_sum_to_one():
    """Over all words, one place for new words in each ending's class, and the end."""
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abcdefghijkl") for _ in range(rng.randint(1, 6))) for _ in range(9000)})
    n = np.array([rng.randint(1, 50) for _ in words])
    own = [recurrent_lm.ending(w) for w in words]
    v = recurrent_lm.Vocabulary(words, n, 40, int(n.sum()) + 40, len(words) + 1, np.bincount(own, minlength=recurrent_lm.ENDINGS), np.bincount(own, n, recurrent_lm.ENDINGS))
    assert len(words) > recurrent_lm.HEADS * recurrent_lm.WORDS_EACH
    flat = v.params() + np.random.default_rng(3).normal(0, 0.3, len(v.params())).astype(np.float32)
    codes = np.concatenate([v.code[:50], v.code[-50:], [0]])
    for classes, inside in plain_steps(gru.views(flat, recurrent_lm.SHAPES), codes):
        head = recurrent_lm.HEADS * recurrent_lm.WORDS_EACH
        place = np.concatenate([[0], v.code])  # the end, and all words
        words_of = [inside(c) for c in range(recurrent_lm.HEADS)]
        p = np.array([classes[c // recurrent_lm.WORDS_EACH] * words_of[c // recurrent_lm.WORDS_EACH][c % recurrent_lm.WORDS_EACH] if c < head else classes[recurrent_lm.HEADS + c - head] for c in place])
        p[1:] *= 10.0**v.inside
        new = (classes[recurrent_lm.HEADS :] * 0.1 / 10.0**v.rare).sum()
        assert p.sum() + new == pytest.approx(1, abs=1e-6)


def test_lm_empty(no_docs):
    assert recurrent_lm.score(no_docs).count() == 0


def test_classifier(spark, docs, rows, no_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    made = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(rng.randint(20, 200)))) for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i, _ in made] + [(None, 1, 0), (5, None, 0), (10_000, 1, 0)], "doc_id long, quality int, toxic int")
    got = knn_quality.score(frame, labels).where("held_out").collect()
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 4 != 0) for r in got) >= 0.98 * len(got) > 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in knn_quality.score(frame, labels).collect())
    whole = knn_quality.score(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(whole) == len(rows) and all(0 <= r["score"] <= 1 for r in whole)
    assert {r["score"] for r in knn_quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert knn_quality.score(no_docs, labels).count() == 0


def test_classifier_votes_like_a_plain_loop(spark):
    """Every document against every labelled one, neighbour by neighbour; ties and repeated rows included."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() + ("##" if i % 3 == 0 else "") for _ in range(rng.randint(5, 60))) for i in range(120)]
    texts += [texts[4], texts[4], None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 124, 2)] + [(4, 0), (4, 1)], "doc_id long, quality int")
    weights, basis, known, y = knn_quality.fit(docs, labels)
    want = []
    for r in docs.collect():
        c = knn_quality.counts(r["text"])
        x = [math.log1p(int(n)) * float(w) for n, w in zip(c, weights, strict=True)]
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        at = np.flatnonzero(c)
        v = sum((x[t] / norm * basis[t].astype(float) for t in at), np.zeros(basis.shape[1]))
        size = math.sqrt(float((v * v).sum()))
        v = v / size if size > 1e-6 else v * 0
        near = sorted((float((v * k).sum()), -i) for i, k in enumerate(known.astype(float)))[::-1][: knn_quality.NEIGHBOURS]
        votes = [(max(cosine, 0.0) ** knn_quality.POWER, float(y[-i])) for cosine, i in near]
        mean = float(y.mean())
        score = (sum(w * label for w, label in votes) + knn_quality.PRIOR * mean) / (sum(w for w, _ in votes) + knn_quality.PRIOR)
        want.append((r["doc_id"], score))
    got = sorted((r["doc_id"], r["score"]) for r in knn_quality.score(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], abs=2e-3)


def brute_neighbours(vectors, k=20, every=20):
    out = {}
    for i, v in vectors.items():
        if i % every == 0:
            near = sorted(((-float((w * v).sum()), j) for j, w in vectors.items() if j != i))[:k]
            out[i] = [j for _, j in near]
    return out


def test_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(900)]
    rows += [(900 + i, [1.0] * 8, 0) for i in range(60)]
    odd = [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [1.0, None] + [1.0] * 6, 0), (2004, [float("inf")] + [1.0] * 7, 0), (2005, [1.0], 0), (None, [1.0] * 8, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, block int").repartition(3)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    want = brute_neighbours(vectors)
    got = {}
    for r in kmeans_tree.search(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float((vectors[r["query_id"]] * vectors[r["vec_id"]]).sum()), abs=1e-9)
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_every_query_gets_all_its_neighbours(spark):
    """A leaf of a few far rows does not end the search, and clustered vectors are found in few leaves."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((16, 8)) * 4
    rows = [(i, (centres[i % 16] + 0.1 * rng.standard_normal(8)).tolist()) for i in range(950)]
    rows += [(1000 + 20 * i, (100 + rng.standard_normal(8)).tolist()) for i in range(10)]
    got = kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).groupBy("query_id").count().collect()
    assert len(got) == sum(i % 20 == 0 for i, _ in rows) and all(r["count"] == 20 for r in got)
    points = np.array([v for _, v in rows])
    tree = kmeans_tree.Tree(points, 32)
    seen = tree.visits(points[0], 1, [3] * tree.leaves, 21)
    assert len(seen) == 7 and sorted(tree.visits(points[0], tree.leaves)) == list(range(tree.leaves))


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 20, 2.0), (2, 20, 1.0), (3, 1, 0.5), (4, 2, 0.5)] * 2 + [(1, 20, 2.0), (2, 20, 2.0), (3, 1, 1.0), (4, 2, 1.0)])


def test_recall_on_the_test_data(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    want = brute_neighbours(vectors)
    got = {}
    for r in kmeans_tree.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(len(v) == 20 for v in got.values())


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in kmeans_tree.search(few).orderBy("rank").collect()] == [(0, 1, 4), (0, 2, 3), (0, 3, 2), (0, 4, 1)]
    assert kmeans_tree.search(few.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert kmeans_tree.search(one).count() == 0


def test_the_model_is_not_shrunk_for_the_check():
    assert gru.HIDDEN >= 16 and recurrent_lm.ENDINGS >= 48 and recurrent_lm.HEADS * recurrent_lm.WORDS_EACH >= 3072
