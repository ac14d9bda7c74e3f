import hashlib

import numpy as np
import pytest

from platelab.llm import repeats, run_index


def brute(rows, window=repeats.WINDOW):
    """Spans judged window by window, in the order of doc_id."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_ROWS, 2])
def test_matches_brute_force(plain_docs, plain, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeats(plain_docs).collect()}
    assert got == brute([(r[0], r[1]) for r in plain])


def test_rows_that_share_an_id(docs, rows):
    got = repeats.repeats(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_bytes"]), set()).add(tuple(r))
    assert all(len(v) == 1 for (i, _), v in by.items() if i is not None)
    assert sum(r["n_removed"] for r in got if r["doc_id"] is None) == 0  # the null id comes first


def test_without_repeats(plain_docs, plain):
    out = repeats.without_repeats(plain_docs)
    assert out.columns == plain_docs.columns and dict(out.dtypes)["n_chars"] == "bigint"
    want = brute([(r[0], r[1]) for r in plain])
    text = {r[0]: r[1] for r in plain}
    for r in out.collect():
        if want[r["doc_id"]][1] == 0:
            assert r["text"] == text[r["doc_id"]]
        else:
            assert len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])


def test_empty(no_docs):
    assert repeats.repeats(no_docs).count() == 0
    assert repeats.without_repeats(no_docs).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(30):
        parts = [np.append(rng.integers(1, 4, rng.integers(0, 30)), 0) for _ in range(rng.integers(1, 12))]
        symbols = np.concatenate(parts)
        closes = np.flatnonzero(symbols == 0)
        left = closes[np.searchsorted(closes, np.arange(len(symbols)))] - np.arange(len(symbols))
        want = sorted(range(len(symbols)), key=lambda i: (symbols[i : i + left[i] + 1].tolist(), i))
        assert run_index.suffix_order(symbols, left).tolist() == want


def test_first_windows():
    rng = np.random.default_rng(3)
    anchor = b"ANCHOR"
    contexts, offsets, group = [], [], []
    for i in range(60):
        left, right = (bytes(rng.integers(97, 99, rng.integers(0, 5)).tolist()) for _ in range(2))
        if len(left) + len(right) >= 4:
            contexts.append(left + anchor + right), offsets.append(len(left)), group.append(i % 2)
    got = run_index.first_windows(np.array(group), contexts, np.array(offsets), 10)
    seen = set()
    for c, o, g, x in zip(contexts, offsets, group, got, strict=True):
        names = [(g, o - k, c[k : k + 10]) for k in range(len(c) - 9)]
        assert x.tolist() == [n in seen for n in names]
        seen.update(names)
