"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback.

Encoding keeps a prefix table: the encoding of every prefix of a piece of text ends in exactly one token. It is the
automaton match ending there whose token is compatible with the last token of the prefix before it, that is, merging
by rank would leave the two side by side. The ids are then recovered from the end backwards. The table is built per
word, as far as no vocabulary piece can span two words, and the ids of frequent words are kept in a bounded cache.

Pieces made of space marks alone share one lowest score, so they merge last and from the left; they are told apart by
the length of a run. Defined results: null text counts as empty; an empty text has the begin and end ids only; very
long texts and words are encoded whole, in one task each; repeated rows give equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, turn_to

SPACE = "▁"
#: Words whose ids a worker remembers (twice as many, as the last full cache is kept), and pairs it remembers.
CACHED_WORDS = 150_000
#: Longer words are encoded anew each time, so that the cache is bounded in bytes too.
CACHED_LETTERS = 64
CACHED_PAIRS = 200_000

codecs.register_error("mark_each_byte", lambda e: ("�", e.start + 1))


class PrefixTable(dict):
    """Maps a word (text without a space mark inside) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.runs = {len(p): i for p, i in self.ids.items() if p.strip(SPACE) == ""}
        words = [i for i in plain if len(self.pieces[i]) == 1 or i not in self.runs.values()]
        scores = {i: model.get_score(i) for i in words}
        lasting = [i for i in words if len(self.pieces[i]) > 1]
        if any(SPACE in self.pieces[i][1:] or "\n" in self.pieces[i] for i in lasting):
            raise ValueError("a piece spans two words")
        if any(model.get_score(i) >= min(scores[j] for j in lasting) for n, i in self.runs.items() if n > 1):
            raise ValueError("runs of space marks do not merge last")
        #: Order in which pieces are merged; single characters come first.
        self.rank = [-1] * len(self.pieces)
        for r, i in enumerate(sorted(lasting, key=lambda i: -scores[i])):
            self.rank[i] = r
        self.word_ids = {self.pieces[i]: i for i in words}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in words:
            piece = self.pieces[i]
            if len(piece) == 1 or self._halve(i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.before: dict[str, bytes] = {}
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in ids:
            if model.is_control(i) or model.is_unknown(i):
                raw[i] = b""
        for b, i in enumerate(self.byte_id):
            raw[i] = bytes([b])
        self.raw = raw
        self.split = re.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}+(?={SPACE}[^{SPACE}\n])|{SPACE}+|\n").findall

    def _halve(self, token: int) -> bool:
        """Find the two tokens that merge into this one; false if merging by rank never makes it."""
        parts = [self.word_ids.get(c, -1) for c in self.pieces[token]]
        if -1 in parts:
            return False
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                made = self.word_ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if made is not None and (best is None or self.rank[made] < self.rank[best]):
                    best, at = made, k
            if best is None:
                return False
            if best == token and len(parts) == 2:
                self.halves[token] = (parts[0], parts[1])
                return True
            parts[at : at + 2] = [best]
        return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these tokens side by side.

        Undo the later of the two tokens' merges again and again; if at any time the two tokens that met would have
        merged with each other sooner than what was undone, they would not have been left.
        """
        key = left << 32 | right
        rank, pieces, made_of = self.rank, self.pieces, self.halves
        limit = len(rank)
        fine = True
        while True:
            made = self.word_ids.get(pieces[left] + pieces[right])
            if made is not None and rank[made] < limit:
                fine = False
                break
            if rank[left] > rank[right]:
                limit = rank[left]
                left = made_of[left][1]
            elif rank[right] >= 0:
                limit = rank[right] + 1
                right = made_of[right][0]
            else:
                break
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def word(self, text: str) -> list[int]:
        """Ids of a text in which no space mark follows another character."""
        last = [-1] * (len(text) + 1)  # -1: a character that the vocabulary lacks
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - length]
                if before >= 0 and (fine := known(before << 32 | token)) is None:
                    fine = self.compatible(before, token)
                if before < 0 or fine:
                    last[end + 1] = token
        out: list[int] = []
        at = len(text)
        while at:
            token = last[at]
            if token < 0:
                out += [self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "replace"))]
                at -= 1
            else:
                out.append(token)
                at -= len(self.pieces[token])
        return out[::-1]

    def run(self, length: int) -> list[int]:
        """Ids of a run of space marks: from the left, grow a token while a longer one exists, by one or by two marks."""
        out = []
        while length:
            n = 1
            while n < length and ((n + 1) in self.runs or (n + 2 <= length and (n + 2) in self.runs and 2 in self.runs)):
                n += 1 if (n + 1) in self.runs else 2
            out.append(self.runs[n])
            length -= n
        return out

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = np.array(self.run(len(word)) if word[-1] == SPACE else self.word(word), "<u4").tobytes()
        if len(word) <= CACHED_LETTERS:
            if len(self) >= CACHED_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        parts = self.split(marked)
        if SPACE * 2 in marked:
            ids = self._with_runs(parts)
        else:
            ids = b"".join(map(self.__getitem__, parts))
        return np.array([self.begin], "<u4").tobytes() + ids + np.array([self.end], "<u4").tobytes() if ends else ids

    def _with_runs(self, parts: list[str]) -> bytes:
        """A run takes in the mark of the word after it, if that word leaves its mark alone."""
        alone = np.array([self.runs[1]], "<u4").tobytes()
        out, run = [], 0
        for part in parts:
            if part[-1] == SPACE:
                run += len(part)
                continue
            ids = self[part]
            if run and part[0] == SPACE and ids[:4] == alone:
                run, ids = run + 1, ids[4:]
            if run:
                out.append(self[SPACE * run])
                run = 0
            out.append(ids)
        if run:
            out.append(self[SPACE * run])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; the mark that encoding puts in front is dropped again."""
        values = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.raw.__getitem__, values))
        first = next((i for i in values if self.raw[i]), None)
        if first is not None and self.pieces[first][0] == SPACE:
            raw = raw[1:]
        return raw.decode("utf-8", "mark_each_byte")


@lru_cache(maxsize=2)
def prefix_table(model_file: str | None = None) -> PrefixTable:
    """The table of a model; one per worker."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return PrefixTable(model_file)


def encoded(text: Column, model_file: str | None = None) -> Column:
    """The ids of each text, begin and end included."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(texts: pa.Array) -> pa.Array:
        turn_to("sentencepiece", prefix_table.cache_clear)
        table = prefix_table(model_file)
        rows = [table.encode(x.as_py()) for x in texts]
        at = np.cumsum([0] + [len(r) // 4 for r in rows])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    return of(text)


def decoded(ids: Column, model_file: str | None = None) -> Column:
    """The text of each array of ids."""

    @F.arrow_udf(T.StringType())
    def of(rows: pa.Array) -> pa.Array:
        turn_to("sentencepiece", prefix_table.cache_clear)
        table = prefix_table(model_file)
        return pa.array([None if not x.is_valid else table.decode(np.array(x.as_py(), "<u4").tobytes()) for x in rows], pa.string())

    return of(ids)


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(docs: DataFrame, model_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the text decoded from them, and if asked for the ids."""
    prepare(docs.sparkSession)

    @F.arrow_udf(T.StructType([*_DIGESTS, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids]))
    def of(texts: pa.Array) -> pa.Array:
        turn_to("sentencepiece", prefix_table.cache_clear)
        table = prefix_table(model_file)
        rows = [table.encode(x.as_py()) for x in texts]
        columns = {
            "n_tokens": pa.array([len(r) // 4 for r in rows], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(table.decode(r).encode()).hexdigest() for r in rows], pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) // 4 for r in rows]), pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", of(F.col("text")).alias("r")).select("doc_id", "r.*")
