import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platelab.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(library, text):
    split = byte_bpe.splitter()
    ids = np.frombuffer(split.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids, text
    assert split.decode(split.encode(text)) == library.decode(ids, skip_special_tokens=False), text


def test_every_character(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        check(library, "".join(f"a{c}1{c}{c}! {c}b  {c}" for c in points[k : k + 4000]))


def test_random_texts(library):
    rng = random.Random(1)
    alphabets = ["abcdefgh ", "aaab ", "the of and ing tion   ", "éèñß漢字ぁ  \n\t", "0123 456.,!?<>", "aA 's're'll \r\n", "\U0001f600\x00 x\x1c\x85\xa0", "qzxjkv", "՘ا१"]
    for _ in range(4000):
        a = rng.choice(alphabets)
        check(library, "".join(rng.choice(a) for _ in range(rng.randint(0, 90))))
    for _ in range(1500):
        check(library, library.decode([rng.randrange(50257) for _ in range(rng.randint(1, 12))], skip_special_tokens=False))


def test_added_tokens(library):
    for text in ("<|endoftext|>", "a <|endoftext|>b", "<|endoftext|><|endoftext|> ", "<|endof<|endoftext|>text|>", "  <|endoftext|>  x"):
        check(library, text)


def test_cuts_are_forced():
    split = byte_bpe.splitter()
    rng = random.Random(2)
    held = {(a, b) for raw in split.raw[:50256] for a, b in zip(raw, raw[1:])}
    for n in (5, 30, 47, 48, 200):
        for _ in range(200):
            word = bytes(rng.randrange(256) for _ in range(n))
            parts = split.fragments(word)
            assert b"".join(parts) == word
            assert all((a[-1], b[0]) not in held for a, b in zip(parts, parts[1:]))
            assert all((x, y) in held for p in parts for x, y in zip(p, p[1:]))


def test_long_words(library):
    for text in ("a" * 100_000, "ab" * 20_000, "the" * 30_000 + "漢" * 5_000):
        start = time.time()
        check(library, text)
        assert time.time() - start < 30


def test_merges_agree():
    split = byte_bpe.splitter()
    rng = random.Random(3)
    for _ in range(2000):
        ids = [split.byte_id[b] for b in bytes(rng.choice(b"etaoinshr ") for _ in range(rng.randint(1, 60)))]
        assert split._merge_short(list(ids)) == split._merge_long(list(ids))


def test_round_trip(docs, rows, no_docs, library):
    got = sorted(tuple(r) for r in byte_bpe.round_trip(docs.where("doc_id is not null")).collect())
    want = []
    for r in rows:
        if r[0] is not None:
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            want.append((r[0], len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.round_trip(no_docs).count() == 0
    x = docs.where("doc_id = 2").select(byte_bpe.encoded(docs["text"]).alias("ids"), "text")
    row = x.select("ids", "text", byte_bpe.decoded(x["ids"]).alias("back")).first()
    assert row["back"] == row["text"]


def test_caches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 50)
    split = byte_bpe.ForcedSplitter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdeé 漢") for _ in range(60))
        assert np.frombuffer(split.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(split) <= 50 and len(split.known) <= 50
