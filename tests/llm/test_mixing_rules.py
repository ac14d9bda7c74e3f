import os
import re
import textwrap

import duckdb
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from platelab.llm import licenses, mixing, near_copies, quality_rules, repeats, simhash

WORD = r"[^\x20\x09-\x0D]+"


def oracle(sql, rows):
    con = duckdb.connect()
    con.register("t", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    con.execute("CREATE TABLE documents AS SELECT * FROM t")
    return con.execute(sql).fetchall()


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("query,sql", [(mixing.mix, mixing.ORACLE_SQL), (quality_rules.judge, quality_rules.ORACLE_SQL), (licenses.scan, licenses.ORACLE_SQL)])
def test_agrees_with_sql(plain_docs, plain, query, sql):
    plain = [r for r in plain if "\x00" not in (r[1] or "")]
    docs = plain_docs.where("text is null or not contains(text, char(0))")
    got = query(docs)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, oracle(sql, plain)))


def test_mix_with_repeats_and_nulls(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(WORD, r[1] or ""))
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert {r["source_size"] for r in got} == set(sizes.values())
    assert abs(sum({r["source_size"]: r["target"] for r in got}.values()) - sum(sizes.values())) < 1e-6
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).na.fill(-1).collect())) == sorted(map(tuple, mixing.mix(docs).na.fill(-1).collect()))
    assert mixing.mixed(docs).columns == docs.columns


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert abs(got["b"] - 2 * got["c"]) < 1e-6 and abs(got["b"] + got["c"] - 1980) < 1e-6


def test_measures():
    assert quality_rules.measure_text("a b c a b c d\n#x\n\nline one\nline one\n")[:5] == (12, 23, 1, 1, 6)
    assert quality_rules.measure_text(None) == (0, 0, 0, 0, 0, 0)


def test_repeated_windows_by_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert quality_rules.measure_text(" ".join(words))[4] == len(covered)


def test_keep_is_what_judge_keeps(plain_docs):
    kept = quality_rules.keep(plain_docs)
    assert kept.columns == plain_docs.columns
    want = {r["doc_id"] for r in quality_rules.judge(plain_docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_junk_goes_and_clean_documents_stay(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(60, 400))), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(word() + rng.choice(["***", "&&&"]) for _ in range(200)), "en", "s", 0) for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)


def prose(rng, n):
    return [("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))) for _ in range(n)]


def test_fences_follow_the_source(spark):
    """What is usual in one source is a fault in another."""
    import random

    rng = random.Random(3)
    code = lambda: " ".join(w + rng.choice(["", "", "", "<", "|"]) for w in prose(rng, rng.randint(80, 300)))
    long_words = lambda: " ".join(w * 2 for w in prose(rng, rng.randint(80, 300)))
    plain = lambda: " ".join(prose(rng, rng.randint(80, 300)))
    rows = [(i, code(), "en", "code") for i in range(400)] + [(1000 + i, plain(), "en", "prose") for i in range(400)] + [(2000 + i, long_words(), "de", "prose") for i in range(400)]
    rows += [(5000, code(), "en", "prose"), (5001, long_words(), "en", "prose"), (5002, plain(), "de", "prose")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame).collect()}
    assert all(got[r[0]] for r in rows[:1200]) and not got[5000] and not got[5001] and not got[5002]
    fences = {(r["lang"], r["source"]): r for r in quality_rules.fences(quality_rules.measures(frame)).collect()}
    assert fences["en", "code"]["symbol_rate_max"] > 3 * fences["en", "prose"]["symbol_rate_max"]
    assert fences["de", "prose"]["word_length_max"] > 1.5 * fences["en", "prose"]["word_length_max"]
    assert len({f["dup_line_rate_max"] for f in fences.values()}) == len({f["repeat_rate_max"] for f in fences.values()}) == 3


def test_small_groups_lean_on_their_language(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 150)), "en", "large") for i in range(300)] + [(1000 + i, " ".join(w + "##" for w in prose(rng, 150)), "en", "tiny") for i in range(6)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[r[0]] for r in rows[300:]) and all(got[r[0]] for r in rows[:300])


CLASHING = ("h", "row", "m", "f", "d", "t", "copies", "threshold", "symbol_rate", "symbol_rate_max", "n_words", "__copy", "own", "fp", "tie", "spans", "doc", "kept", "times")


def with_clashes(docs):
    """Columns under the names that the operators use themselves, with values that tell rows apart."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])


def same_rows(got, given):
    """Every row of ``got`` is one of ``given``, in all its columns."""
    known = {tuple(r) for r in given.collect()}
    rows = [tuple(r) for r in got.collect()]
    return bool(rows) and set(rows) <= known


def test_no_column_clashes(plain_docs):
    given = with_clashes(plain_docs)
    for of in (quality_rules.keep, mixing.mixed, simhash.keep_one, near_copies.keep_one):
        got = of(given)
        assert got.columns == given.columns and same_rows(got, given), of
    got = repeats.without_repeats(given)
    assert got.columns == given.columns and same_rows(got.drop("text", "n_chars"), given.drop("text", "n_chars"))


def test_licenses(spark, docs, rows):
    mit = licenses.TITLED["MIT"][1]
    texts = [mit.upper(), "Copyright (c) 2020 Someone\nCopyright 2021 Others\n" + mit, mit.replace("sublicense", "sub-licence").replace(", ", " ,\n  "), mit + " with changes", "released under  the MIT licence", None]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: "notice: MIT", 5: None}
    assert licenses.scan(docs).count() == len(rows)


def layouts(name):
    """The layouts in which a licence file is found."""
    titles, text = licenses.TITLED[name]
    notice = "Copyright (c) 2019-2024, Jane Doe <jane@example.org>"
    wrapped = "\n\n".join(textwrap.fill(p, 72) for p in text.split("\n\n"))
    narrow = "\n\n".join(textwrap.fill(p, 40) for p in text.split("\n\n"))
    yield f"{titles[0]}\n\n{notice}\n\n{wrapped}\n"
    yield f"{notice}\nAll rights reserved.\n\n{narrow}"
    yield f"{notice}. {' '.join(text.split())}"
    yield f"Copyright Jane Doe and others\n\n{wrapped}".replace("\n", "\r\n")
    yield "\n".join(" * " + line for line in f"{notice}\n\n{wrapped}".split("\n"))
    yield "\n".join("# " + line for line in f"{titles[-1].upper()}\n(C) 2001 X\n{narrow}".split("\n"))


def test_usual_layouts_of_licences(spark):
    texts = [(name, text) for name in licenses.TITLED if licenses.TITLED[name][0] for text in layouts(name)]
    assert any("\ncopyright notice" in t for n, t in texts if n == "ISC")  # a sentence that wraps before these words
    rows = [(i, t, name, None) for i, (name, t) in enumerate(texts)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string, x string")).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert {r[0]: r[2] for r in oracle(licenses.ORACLE_SQL, rows)} == got


def test_long_licences(spark):
    folder = "/usr/share/common-licenses"
    names = sorted(n for n in licenses.DIGESTS if os.path.isfile(f"{folder}/{n}"))
    if not names:
        pytest.skip("no licence texts on this machine")
    rows = [(i, open(f"{folder}/{n}", encoding="utf-8").read().upper() + "\n\n", n, None) for i, n in enumerate(names)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string, x string")).collect()}
    assert got == dict(enumerate(names))
    assert {r[0]: r[2] for r in oracle(licenses.ORACLE_SQL, rows)} == got


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == mixing.mixed(no_docs).count() == quality_rules.judge(no_docs).count() == quality_rules.keep(no_docs).count() == licenses.scan(no_docs).count() == 0


def test_targets_by_plain_sharing(spark):
    import random

    rng = random.Random(7)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:03d}": rng.choice([0, 1, 3, 10, 100, 1000, 100_000]) for i in range(n)}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        stopped, total = set(), sum(sizes.values())
        while True:
            left = total - sum(3 * sizes[s] for s in stopped)
            rest = sum(weight[s] for s in sizes if s not in stopped)
            share = {s: 3 * sizes[s] if s in stopped else left * weight[s] / rest for s in sizes}
            over = {s for s in sizes if share[s] > 3 * sizes[s]}
            if not over:
                break
            stopped |= over
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(share)
