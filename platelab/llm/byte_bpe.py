"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never end up in one token, so a
cut between them is certain and no merge on one side depends on the other side. Each word that the vocabulary's
pattern splits off is cut at all such pairs; the fragments are encoded independently, each by merging the pair of
lowest rank first, and their ids are concatenated. Fragments are short and repeat more often than words do; the ids of
frequent words and fragments are kept in caches of bounded size.

Added tokens of the vocabulary file (such as an end mark) that occur in a text are one id each, as they stand.

Defined results: null text counts as empty and has no ids; very long texts, words and fragments are encoded whole, in
one task each, in time that grows with n log n; repeated rows give equal rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .token_counts import byte_of_symbol

#: Words (twice as many, as the last full cache is kept) and fragments that a worker remembers, and the longest it remembers, so that caches are bounded in bytes too.
CACHED = 150_000
CACHED_LETTERS = 64
#: Longer fragments are merged with a heap.
SHORT = 48
#: Ids have fewer bits than this; what stands for a pair that does not merge.
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 2 * BITS

#: The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that came after the Unicode version (16) of the vocabulary's pattern.
LATER_RANGES = """
0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2
A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1
1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
LATER = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER_RANGES.split())


def _later_as_symbols(pattern: str) -> str:
    """``pattern`` for texts with characters of ``LATER``, which then are neither letters nor numbers."""
    others = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]{LATER}]")
    return re.sub(r" \?\\p\{([LN])\}\+", lambda m: f" ?[\\p{{{m[1]}}}--[{LATER}]]+", others)


class ForcedSplitter(dict):
    """Maps a word (as the pattern splits them) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary_file: str):
        super().__init__()
        with open(vocabulary_file) as f:
            read = json.load(f)
        symbol = byte_of_symbol()
        vocabulary, added = read["model"]["vocab"], read.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.raw = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, i in vocabulary.items():
            if token not in self.added:
                self.raw[i] = bytes(symbol[c] for c in token)
        self.byte_id = [0] * 256
        for i, raw in enumerate(self.raw):
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        #: inside[256 * x + y]: some token holds the bytes x, y side by side.
        self.inside = np.zeros(1 << 16, bool)
        for raw in self.raw:
            for x, y in zip(raw, raw[1:]):
                self.inside[x << 8 | y] = True
        self.joined = self.inside.tolist()
        for token, i in self.added.items():
            self.raw[i] = token.encode()
        #: Rank and result of merging two ids, as one number that sorts by rank.
        self.merged: dict[int, int] = {}
        for rank, merge in enumerate(read["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merged[vocabulary[left] << BITS | vocabulary[right]] = rank << BITS | vocabulary[left + right]
        self.decimal = [str(i) for i in range(len(self.raw))]
        self.words = regex.compile(PATTERN).findall
        self.words_later = regex.compile(_later_as_symbols(PATTERN), regex.V1).findall
        self.has_later = re.compile(f"[{LATER}]").search
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[str, bytes] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """``word`` cut wherever two bytes stand side by side that no token holds."""
        if len(word) < SHORT:
            joined, start, out = self.joined, 0, []
            for k in range(1, len(word)):
                if not joined[word[k - 1] << 8 | word[k]]:
                    out.append(word[start:k])
                    start = k
            out.append(word[start:])
            return out
        of = np.frombuffer(word, np.uint8).astype(np.int32)
        at = [0, *(np.flatnonzero(~self.inside[of[:-1] << 8 | of[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def _merge_short(self, ids: list[int]) -> list[int]:
        known = self.merged.get
        pairs = [known(a << BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NONE:
            k = pairs.index(best)
            ids[k : k + 2] = [best & MASK]
            del pairs[k]
            if k:
                pairs[k - 1] = known(ids[k - 1] << BITS | ids[k], NONE)
            if k < len(pairs):
                pairs[k] = known(ids[k] << BITS | ids[k + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place), over a list linked both ways."""
        known, n = self.merged.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f, k) for k in range(n - 1) if (f := known(ids[k] << BITS | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            f, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt < 0 or known(ids[k] << BITS | ids[nxt]) != f:
                continue
            ids[k], ids[nxt] = f & MASK, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if (f := known(ids[k] << BITS | ids[after[k]])) is not None:
                    heapq.heappush(heap, (f, k))
            if before[k] >= 0 and (f := known(ids[before[k]] << BITS | ids[k])) is not None:
                heapq.heappush(heap, (f, before[k]))
        return [i for i in ids if i >= 0]

    def fragment(self, raw: bytes) -> bytes:
        """Ids of one fragment."""
        found = self.known.get(raw)
        if found is None:
            ids = [self.byte_id[b] for b in raw]
            found = np.array(self._merge_short(ids) if len(ids) < SHORT else self._merge_long(ids), "<u4").tobytes()
            if len(raw) <= CACHED_LETTERS:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[raw] = found
        return found

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = b"".join(map(self.fragment, self.fragments(word.encode("utf-8", "replace"))))
        if len(word) <= CACHED_LETTERS:
            if len(self) >= CACHED:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            words = self.words
        except UnicodeEncodeError:
            words = self.words_later if self.has_later(text) else self.words
        return b"".join(map(self.__getitem__, words(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.parts is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.parts(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def listed(self, ids: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist())).encode()


@lru_cache(maxsize=2)
def splitter(vocabulary_file: str | None = None) -> ForcedSplitter:
    """The splitter of a vocabulary; one per worker."""
    if vocabulary_file is None:
        import public_tokenizers

        vocabulary_file = public_tokenizers.path("byte_bpe_50k.json")
    return ForcedSplitter(vocabulary_file)


def _lists(rows: list[bytes]) -> pa.Array:
    at = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encoded(text: Column, vocabulary_file: str | None = None) -> Column:
    """The ids of each text."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(texts: pa.Array) -> pa.Array:
        split = splitter(vocabulary_file)
        return _lists([split.encode(x.as_py()) for x in texts])

    return of(text)


def decoded(ids: Column, vocabulary_file: str | None = None) -> Column:
    """The text of each array of ids; null stays null."""

    @F.arrow_udf(T.StringType())
    def of(rows: pa.Array) -> pa.Array:
        split = splitter(vocabulary_file)
        return pa.array([None if not x.is_valid else split.decode(np.array(x.as_py(), "<u4").tobytes()) for x in rows], pa.string())

    return of(ids)


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """doc_id, number of ids, digests of the listed ids and of the text decoded from them."""
    prepare(docs.sparkSession)

    @F.arrow_udf(_DIGESTS)
    def of(texts: pa.Array) -> pa.Array:
        split = splitter(vocabulary_file)
        rows = [split.encode(x.as_py()) for x in texts]
        columns = [
            pa.array([len(r) // 4 for r in rows], pa.int64()),
            pa.array([hashlib.sha256(split.listed(r)).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(split.decode(r).encode()).hexdigest() for r in rows], pa.string()),
        ]
        return pa.StructArray.from_arrays(columns, _DIGESTS.names)

    return docs.select("doc_id", of(F.col("text")).alias("r")).select("doc_id", "r.*")
