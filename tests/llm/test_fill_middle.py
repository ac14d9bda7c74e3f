import hashlib

from pyspark.sql import functions as F

from platelab.llm import fill_middle

from test_mixing_rules import key, oracle


def plain_form(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_plain_python(docs, rows):
    got = sorted(map(key, map(tuple, fill_middle.digests(docs).collect())))
    want = []
    for r in rows:
        n, form, a, m, output = plain_form(r[0], r[1])
        want.append((r[0], n, form, a, m, sha(output), sha(r[1] or "")))
    assert got == sorted(map(key, want))


def test_hard_texts(spark, no_docs):
    pieces = ["<", "P>", "<P", ">", "S", "M>", "<M", "é", "\U0001f600", "\n", "\x00", "\\", "$1", "é", "\r\n"]
    texts = ["".join(pieces[(i * 7 + j * (i % 5 + 1)) % len(pieces)] for j in range(i % 23)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(0), "row": F.lit(1), "units": F.lit(2)})
    got = {r["doc_id"]: r for r in fill_middle.transform(docs).select("row.doc_id", "row.units", "form", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["output"] == plain_form(i, t)[4] and got[i]["back"] == t and got[i]["units"] == 2
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    assert fill_middle.digests(no_docs).count() == 0


def test_agrees_with_sql(plain_docs, plain):
    plain = [r for r in plain if "\x00" not in (r[1] or "")]
    got = fill_middle.digests(plain_docs.where("text is null or not contains(text, char(0))"))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, oracle(fill_middle.ORACLE_SQL, plain)))


def test_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fill_middle.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 1
