import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from platelab.llm import spelling

from test_mixing_rules import oracle


def plain_words(rows):
    n = {}
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form is not None else None, None]
    for w in n:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w][4] = root
    return {(w, *v) for w, v in out.items()}


def table(spark, n):
    return spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")


def test_against_all_pairs(spark):
    rng = random.Random(5)
    for alphabet, length, words in (("ab", 6, 120), ("abcdeé", 7, 500), ("aÿ\U0001f600漢", 5, 300), ("a", 30, 30)):
        n = {}
        while len(n) < words:
            w = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, length) if alphabet != "a" else len(n)))
            n[w] = rng.choice([1, 2, 3, 4, 5, 9, 20, 100, 400])
            if len(alphabet) == 2 and len(n) == 2**7 - 2:
                break
        got = {tuple(r) for r in spelling.grouped(table(spark, n).repartition(3)).collect()}
        assert got == plain_groups(n)


def test_long_words_and_chains(spark):
    long = "x" * 3000
    n = {long: 5, long + "x": 10, long[:-1] + "y": 20, "y" + long[1:]: 40, long[:1500] + long[1501:] + "q": 3}
    n |= {"q" * k + "r": 2**k for k in range(1, 20)}
    assert {tuple(r) for r in spelling.grouped(table(spark, n)).collect()} == plain_groups(n)


def test_without_a_broadcast_edge(spark, monkeypatch):
    rng = random.Random(6)
    n = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))): rng.randint(1, 50) for _ in range(400)}
    for big in (1, 50):
        monkeypatch.setattr(spelling, "BIG", big)
        assert {tuple(r) for r in spelling.grouped(table(spark, n)).collect()} == plain_groups(n)


def test_light_edges_are_few(spark):
    rng = random.Random(7)
    n = {"".join(rng.choice("abcdefgh") for _ in range(10)): 3 for _ in range(4096)}
    edges = spelling.light_edges(table(spark, n)).select(F.size("light").alias("k")).agg(F.max("k"), F.avg("k")).first()
    assert edges[0] <= 12 and edges[1] < 7


def test_variants(docs, rows, no_docs):
    got = sorted(map(str, map(tuple, spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())))
    assert got == sorted(map(str, plain_groups(plain_words(rows))))
    assert spelling.variants(no_docs).count() == 0


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = sorted(map(str, map(tuple, spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())))
    assert got == sorted(map(str, oracle(spelling.ORACLE_SQL, rows)))
    assert got == sorted(map(str, plain_groups(plain_words(rows))))
    assert len(got) > 100 and duckdb.__version__
