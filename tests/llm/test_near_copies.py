import random
import re

import numpy as np

from corpus_pipeline import near_duplicates
from platelab.llm import near_copies, simhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_groups(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited():
    """Texts with some words replaced, so that similarities lie on both sides of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    texts = []
    for edits in (1, 2, 3, 4, 5, 6, 8) * 4:
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(3):
            for at in rng.sample(range(200), edits):
                words[at] = word()
            texts.append(" ".join(words))
    return texts


def test_stage_keeps_one_of_each_group_of_similarity_four_fifths(spark):
    texts = edited() + ["", None, " \n", "a b", "A  b"]
    want = {label for label in brute_groups(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near_duplicates(spark, docs, "").collect()} == want
    assert len(want) < simhash.keep_one(docs).count()


def test_documents_with_nulls_and_repeats(docs, rows, no_docs):
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_groups([r[1] for r in rows])))
    assert near_copies.keep_one(no_docs).count() == 0


def made(n, seed):
    """Fingerprints, some of them copies with bits flipped, and sizes of sets."""
    rng = np.random.default_rng(seed)
    out = np.empty(n, near_copies._HELD)
    out["fp"] = rng.permutation(n) + seed * 1_000_000
    out["root"], out["n"] = out["fp"], rng.integers(90, 110, n)
    bits = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    for i in range(n // 2, n):
        bits[i] = bits[rng.integers(0, n // 3 if i % 2 else 3)]
        bits[i, rng.choice(256, rng.integers(0, 90), replace=False)] ^= 1
    out["sim"] = np.packbits(bits, axis=1).view("<u8")
    return out


def candidate_pairs(a, b):
    first = np.bitwise_count(a["sim"][:, None, 0] ^ b["sim"][None, :, 0]) <= near_copies.FIRST
    near = np.bitwise_count(a["sim"][:, None] ^ b["sim"][None]).sum(axis=2, dtype=np.int32) <= near_copies.RADIUS
    n, m = a["n"][:, None], b["n"][None]
    return first & near & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def components(edges, ids):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        label[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_tiles_against_all_pairs(monkeypatch):
    monkeypatch.setattr(near_copies, "_COLUMNS", 256)
    a, b = made(700, 1), made(300, 2)
    b["sim"][:20] = a["sim"][:20]
    for other in (None, b):
        p, q = np.nonzero(candidate_pairs(a, a if other is None else other))
        second = a if other is None else other
        want = {(int(a["fp"][i]), int(second["fp"][j])) for i, j in zip(p, q, strict=True) if other is not None or i < j}
        every = [(int(x), int(y)) for u, v in near_copies.tile_edges(a, other, False) for x, y in zip(u, v, strict=True)]
        assert set(every) == want and len(every) == len(want) > 100
        ids = [int(x) for t in (a, other) if t is not None for x in t["fp"]]
        forest = [(int(x), int(y)) for u, v in near_copies.tile_edges(a, other, True) for x, y in zip(u, v, strict=True)]
        assert set(forest) <= want and components(forest, ids) == components(want, ids)
        assert len(forest) == len(ids) - len(set(components(want, ids).values()))


def test_small_tiles_find_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE", 4)
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == set(brute_groups(texts))


def test_tiles_cover_all_rows_and_all_near_tiles():
    rng = np.random.default_rng(3)
    sizes = {(int(c), int(p)): int(rng.integers(1, 90_000)) for c in range(4) for p in rng.choice(257, 60, replace=False)}
    places, partners = near_copies._tiles(sizes)
    count = max(f + n for _, _, f, n in places)
    of = [set() for _ in range(count)]
    for c, p, f, n in places:
        for t in range(f, f + n):
            of[t].add((c, p))
    assert {(c, p) for c, p, _, _ in places} == set(sizes)
    meet = {(i, j) for i, low, high in partners for j in range(low, high + 1)}
    for i in range(count):
        for j in range(count):
            if any(abs(c - d) <= 1 and abs(p - q) <= near_copies.RADIUS for c, p in of[i] for d, q in of[j]):
                assert (i, j) in meet
    assert all((j, i) in meet for i, j in meet)
