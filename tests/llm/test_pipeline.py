import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from corpus_pipeline import STAGES, run
from platelab.llm import mixing, quality_rules
from platelab.llm.common import written

from test_near_copies import brute_groups
from test_repeats import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Prose in two languages and three sources, with junk, copies, near copies, shared passages and nulls."""
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    prose = lambda n, letters="etaoinshrdlu": [word(letters) for _ in range(n)]
    shared = " ".join(prose(60))
    texts = [prose(rng.randint(70, 160)) for _ in range(70)]
    for i in range(0, 30, 3):
        near = list(texts[i])
        near[rng.randrange(len(near))] = "changed"
        texts.append(near)
    texts += [list(texts[5]), list(texts[5]), [w.upper() for w in texts[7]]]
    texts += [[*prose(50), shared, *prose(40)] for _ in range(8)]
    texts += [[w + "###" for w in prose(90)] for _ in range(5)] + [prose(20), []]
    rows = [(i, " ".join(t), "en" if i % 3 else "de", ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(texts)]
    rows += [(len(rows), None, "en", "s1"), (len(rows) + 1, "word\n\n" * 60, None, "s2"), (len(rows) + 2, "Ünïcode 漢字 " + " ".join(prose(80)), "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows]


def table(rows):
    con = duckdb.connect()
    con.register("t", pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))}))
    con.execute("CREATE TABLE documents AS SELECT * FROM t")
    return con


def plain_quality(rows):
    found = table(rows).execute(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()
    kept = {i for (i,) in found}
    return [r for r in rows if r[0] in kept]


def plain_near(rows):
    rows = sorted(rows)
    label = brute_groups([r[1] for r in rows])
    return [r for i, r in enumerate(rows) if label[i] == i]


def plain_passages(rows):
    out, seen = [], set()
    for i, text, lang, source, _ in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            gone[k : k + 100] |= raw[k : k + 100] in seen
            seen.add(raw[k : k + 100])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        out.append((i, left, lang, source, len(left)))
    return out


def plain_mix(rows):
    times = {i: taken // size for i, size, taken in table(rows).execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL}) WHERE size > 0").fetchall()}
    return [r for r in rows for _ in range(times.get(r[0], 0))]


def plain_encode(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for r in rows:
        ids = library.encode(r[1], add_bos=True, add_eos=True)
        out.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    return out


def test_every_stage_does_what_plain_python_does(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(rows)]
    for (name, stage), plain in zip(STAGES, (plain_quality, plain_near, plain_passages, plain_mix, plain_encode), strict=True):
        docs, rows = written(stage(spark, docs, "")), plain(rows)
        sizes.append(len(rows))
        columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if name == "sentencepiece" else ("doc_id", "text", "lang", "source", "n_chars")
        if name != "sentencepiece":
            assert docs.columns == list(columns)
        key = lambda r: [str(x) for x in r]
        assert sorted(map(tuple, docs.select(*columns).collect()), key=key) == sorted(rows, key=key), name
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] != sizes[3]  # each of these stages had something to do
    assert any(x[2] for x in brute([(r[0], r[1]) for r in plain_near(plain_quality(corpus()))]).values())
    whole = run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, whole)) == sorted(rows)


def test_nulls_repeats_and_empty_tables(spark, tmp_path, docs, no_docs):
    for k, frame in enumerate((docs, no_docs)):
        frame.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = run(spark, f"{tmp_path}/{k}")
        assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and (out.count() > 0) == (k == 0)
