"""What the review of round 4 found in the passage stage: its index is searched and sorted no more than it needs."""

import random

import numpy as np

from platelab.llm import run_index


def test_ends_of_matches_are_looked_up_only_where_a_run_begins_within(monkeypatch):
    rng = random.Random(6)
    core = bytes(rng.choice(b"abcd") for _ in range(30))
    contexts, offsets, group = [], [], []
    for i in range(400):
        left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 40))) for _ in range(2))
        contexts.append(contexts[-1] if i % 7 == 6 else left + core + right)
        offsets.append(offsets[-1] if i % 7 == 6 else len(left))
        group.append(group[-1] if i % 7 == 6 else i % 5)
    asked, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **named: asked.append(np.size(v)) or plain(a, v, *rest, **named))
    got = run_index.first_windows(np.array(group, np.uint64), contexts, np.array(offsets), 80)
    monkeypatch.undo()
    steps = sum(o + min(80, len(c) - o) for c, o in zip(contexts, offsets, strict=True))
    assert sum(asked) < 1.5 * steps
    seen = set()
    for c, o, g, found in zip(contexts, offsets, group, got, strict=True):
        names = [(g, o - k, c[k : k + 80]) for k in range(len(c) - 79)]
        assert [bool(x) for x in found] == [n in seen for n in names]
        seen.update(names)


def test_suffixes_that_are_told_apart_are_not_sorted_again():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 5, 300) for _ in range(20)]
    texts += [texts[3], texts[3][50:], np.ones(700, np.int64), np.ones(1, np.int64)]
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    closes = np.flatnonzero(symbols == 0)
    left = np.repeat(closes, np.diff(closes, prepend=-1)) - np.arange(len(symbols))
    want = sorted(range(len(symbols)), key=lambda i: (symbols[i : i + left[i]].tolist(), i))
    assert run_index.suffix_order(symbols, left).tolist() == want
