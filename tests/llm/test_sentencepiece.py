import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from platelab.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def check(library, text):
    table = sp.prefix_table()
    ids = np.frombuffer(table.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True), text
    assert table.decode(table.encode(text)) == library.decode(ids), text


def test_runs_of_spaces(library):
    for n in range(1, 60):
        for text in (" " * n, " " * n + "a", "a" + " " * n + "漢b", " " * n + "\n" + " " * n + "9"):
            check(library, text)


def test_random_texts(library):
    rng = random.Random(1)
    alphabets = ["abcdefgh ", "aaab ", "the of and ing tion   ", "éèñß漢字ぁ  \n\t", "0123 456.,!?<>", "aA ▁ <0x0A> </s>", "\U0001f600\x00 x", "er in on re ▁▁ st"]
    for _ in range(3000):
        a = rng.choice(alphabets)
        check(library, "".join(rng.choice(a) for _ in range(rng.randint(0, 40))))
    for _ in range(1000):
        check(library, "".join(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(rng.randint(1, 8))))


def test_decode_of_any_ids(library):
    table = sp.prefix_table()
    for ids in ([], [1, 2], [259 + 5, 3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [1, 306, 450, 2]):
        assert table.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_round_trip(docs, rows, library):
    got = sorted(tuple(r) for r in sp.round_trip(docs.where("doc_id is not null")).collect())
    want = []
    for r in rows:
        if r[0] is not None:
            ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
            want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_columns_and_empty(docs, no_docs):
    x = docs.where("doc_id = 2").select(sp.encoded(docs["text"]).alias("ids"), "text")
    row = x.select("ids", "text", sp.decoded(x["ids"]).alias("back")).first()
    assert row["back"] == row["text"]
    assert sp.round_trip(no_docs, with_ids=True).count() == 0
