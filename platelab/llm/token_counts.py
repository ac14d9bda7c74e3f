"""Token counts: how many pieces greedy longest-match word-piece splitting makes of each document.

An automaton over the vocabulary's trie reads each word once. Every node knows what to do when no longer piece can
match: how many pieces are finished then, and the node that stands for the rest. So lengths come out in linear time
and no piece is ever built. Words are in lower case (A-Z only) and end with the vocabulary's word end; an end that
the last piece does not take in costs nothing.

Defined results: null text has no words; a word that cannot be split into pieces counts as one unknown piece; very long
texts and words are read whole, in one task each; an empty table gives an empty result; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, prepare

CACHED = 300_000
#: Longer words are counted anew each time, so that the cache is bounded in bytes too.
CACHED_BYTES = 64
WORD_END = "</w>"
END = 256


def byte_of_symbol() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte, the other bytes follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton(dict):
    """Maps a word (bytes) to its number of pieces, 0 if it has no split; remembers words up to a bound."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        super().__init__()
        self.child: list[dict[int, int]] = [{}]
        whole = {0: False}
        for piece in [*pieces, (END,)]:
            node = 0
            for symbol in piece:
                node = self.child[node].setdefault(symbol, len(self.child))
                if node == len(self.child):
                    self.child.append({})
            whole[node] = True
        #: Where matching goes on if no child fits (None: the word has no split), and the pieces finished by then.
        self.fail: list[int | None] = [None] * len(self.child)
        self.popped = [0] * len(self.child)
        bare_end = self.child[0][END]
        waiting = deque([0])
        while waiting:
            above = waiting.popleft()
            for symbol, node in self.child[above].items():
                waiting.append(node)
                if whole.get(node):
                    self.fail[node], self.popped[node] = 0, int(node != bare_end)
                    continue
                rest, done = self.fail[above], self.popped[above]
                while rest is not None and symbol not in self.child[rest]:
                    done += self.popped[rest]
                    rest = self.fail[rest]
                if rest is not None:
                    self.fail[node], self.popped[node] = self.child[rest][symbol], done

    def length(self, symbols: list[int]) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for symbol in symbols:
            while (following := child[node].get(symbol)) is None:
                count += popped[node]
                if (node := fail[node]) is None:
                    return 0
            node = following
        while node:
            count += popped[node]
            if (node := fail[node]) is None:
                return 0
        return count

    def __missing__(self, word: bytes) -> int:
        found = self.length([*word, END])
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


def pieces_of(vocabulary_file: str | None = None) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as symbols; special tokens are left out."""
    if vocabulary_file is None:
        import public_tokenizers

        vocabulary_file = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary_file) as f:
        read = json.load(f)
    special = {t["content"] for t in read.get("added_tokens", [])}
    symbol = byte_of_symbol()
    return [tuple(symbol[c] for c in t.removesuffix(WORD_END)) + (END,) * t.endswith(WORD_END) for t in read["model"]["vocab"] if t not in special]


@lru_cache(maxsize=2)
def automaton(vocabulary_file: str | None = None) -> Automaton:
    """The automaton of a vocabulary; one per worker."""
    return Automaton(pieces_of(vocabulary_file))


_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")])


def counted(text: Column, vocabulary_file: str | None = None) -> Column:
    """Words, pieces (unknown words count as one) and unknown words of each text."""

    @F.arrow_udf(_COUNTS)
    def of(texts: pa.Array) -> pa.Array:
        lengths = automaton(vocabulary_file)
        words, tokens, unknown = [], [], []
        for x in texts:
            found = list(map(lengths.__getitem__, as_bytes(x.as_py()).lower().split()))
            none = found.count(0)
            words.append(len(found)), tokens.append(sum(found) + none), unknown.append(none)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, tokens, unknown)], _COUNTS.names)

    return of(text)


def token_counts(docs: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", counted(F.col("text"), vocabulary_file).alias("c")).select("doc_id", "c.*")
