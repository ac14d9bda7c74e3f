import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, tie string, fp long, score double, size string, kept boolean, d string, t string, bucket int, at int"


def _text(rng, alphabet="abcdefgh", n=60):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in any column, repeats, near copies, ties, a long text and shared passages."""
    rng = random.Random(4)
    passage = _text(rng, n=80)
    texts = [_text(rng, n=rng.randint(0, 120)) for _ in range(40)]
    texts += [passage + " " + _text(rng, n=30), _text(rng, n=30) + passage, passage, passage]
    texts += [texts[5], texts[5], texts[6] + " x", texts[6][:-3]]
    texts += [None, "", " \n\t ", "one", "Two words", "a" * 700, "ab " * 400, "Ünïcode 漢字 é\x00 ▁ " * 30, "x &&& y *** | z\nsame line\nsame line\n" * 20]
    texts += [_text(rng, n=20_000)]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, ""][i % 4], len(t or ""), i, "x", 1, 0.5, "s", True, "d", "t", 0, 0) for i, t in enumerate(texts)]
    out += [out[3], out[3], (3, "other text under the same id " * 9, *out[3][2:]), (None, passage, *out[3][2:]), (None, None, None, None, None, *out[3][5:])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(rows):
    """Documents with an id of their own only."""
    seen = {}
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen[r[0]] = r
    return list(seen.values())


@pytest.fixture(scope="session")
def plain_docs(spark, plain):
    return spark.createDataFrame(plain, SCHEMA).repartition(3).cache()
