import re

import numpy as np
import xxhash

from platelab.llm import components, simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    """Least position reachable through at most three differing bits."""
    label = list(range(len(fingerprints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fingerprints):
            for j, b in enumerate(fingerprints):
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints_and_components(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(r[1]) for r in rows]
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((r[0] or -1, f"{f:016x}") for r, f in zip(rows, prints, strict=True))
    label = brute_components(prints)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = {f"{f:016x}": least.get(c) for f, c in zip(prints, label, strict=True)}
    assert all(r["component_id"] == want[r["fingerprint"]] for r in got)


def test_same_hash_as_the_engine(spark):
    from pyspark.sql import functions as F

    for s in ("", "a", "word one two", "é漢字" * 20):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_tiles_find_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 4), dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], base ^ flips[:, 2] ^ flips[:, 3] ^ flips[:, 0] ^ flips[:, 1]]))
    label = np.arange(len(x))
    u, v = simhash.tile_forest(x, None)
    simhash._union(label, np.searchsorted(x, u), np.searchsorted(x, v))
    want = brute_components(x.tolist())
    assert len({(a, b) for a, b in zip(label.tolist(), want, strict=True)}) == len(set(want)) == len(set(label.tolist()))
    a, b = x[::2], x[1::2]
    u, v = simhash.tile_forest(a, b)
    cross = np.arange(len(x))
    for part in (simhash.tile_forest(a, None), simhash.tile_forest(b, None), (u, v)):
        simhash._union(cross, np.searchsorted(x, part[0]), np.searchsorted(x, part[1]))
    assert len(set(cross.tolist())) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 60)}, 200: 200, 201: 200}


def test_keep_one_leaves_one_row_of_each_component(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [brute_fingerprint(r[1]) for r in rows]
    assert kept.count() == len(set(brute_components(prints)))


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
