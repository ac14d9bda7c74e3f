"""Scoring of documents by a gated recurrent language model that is trained on the corpus itself.

1. Words of the training documents are counted: each task counts its own, buckets of words add up.
2. The vocabulary for the model: the most frequent words are head words of their own; all other words fall into
   classes by their ending, within which a word has its share of the counts, with one place for words never seen.
3. Every document is turned into codes once: two bytes a token, written to the shared folder. Words beyond the ``KNOWN``
   most frequent have their counts looked up bucket by bucket, so that what is broadcast stays within a bound.
4. Training reads the codes of every training document once, in ``ROUNDS`` rounds. In each round every task starts from
   the broadcast model and trains on its part by truncated backpropagation, with states carried from window to window.
   Long documents run in segments next to each other; a segment begins ``WARM`` tokens early, where only its state
   moves, so that what came before is carried into it. The models are averaged by tokens. The average depends on how
   the table is split into tasks, not on their order.
5. Scoring carries the state through each whole document.

Defined results: null text counts as empty, so it is scored for its end alone; a null doc_id is taken as the empty
string for the split; repeated rows are separate documents; very long texts are whole documents like any other, run side
by side with other long ones; words of equal counts are ranked by their bytes; without training documents every token
has base probability 1 and the model is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import checkpointed, prepare, written

FOLDS = 10
SMOOTHING = 0.1
HEADS, WORDS_EACH = 48, 64
ENDINGS = 48
#: Words whose counts are broadcast, at most.
KNOWN = 1 << 18
#: Sixteenths of the training documents in each round, and the rate of its steps.
ROUNDS = ((2, 0.012), (6, 0.006), (8, 0.003))
COUNTED = 200_000
#: Text that a task turns into codes at one time.
CHUNK_BYTES = 8 << 20
#: Tokens that a task runs side by side, but for a longer document; documents of over ``LONG`` tokens run
#: among themselves and with the last of the others.
CHUNK_TOKENS, LONG = 2 << 20, 4096
#: Tokens of a document that run in one lane in training, and tokens before them that move the state only.
SEGMENT, WARM = 512, 32
BUCKET_BYTES = 32 << 20
#: Parameters in a row of a task's model, and tasks whose models are added up at one place.
PIECE, TOGETHER = 1 << 13, 256

_COUNTS = "bucket long, words binary, n binary"


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class _Endings(dict):
    def __missing__(self, tail: bytes) -> int:
        found = self[tail] = zlib.crc32(tail) % ENDINGS
        return found


_ENDINGS = _Endings()


def _blobs(words: list[bytes], buckets: int) -> Iterator[tuple[int, list[int]]]:
    """Indexes of words by bucket."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(zlib.crc32(w) % buckets, []).append(i)
    yield from by.items()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, in lower case, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = lists.flatten().cast(pa.binary())
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.binary_length(flat).to_numpy() > 0  # an empty text has one empty word
    return (flat, doc) if real.all() else (flat.filter(pa.array(real)), doc[real])


def _listed(values: pa.Array) -> list:
    """Values without nulls as Python objects, several times as fast as by ``to_pylist``, which makes a scalar of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """Texts (the last column) and the other columns of their rows, in chunks of bounded size."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        top = 0
        while top < len(texts):
            end = max(top + 1, int(np.searchsorted(upto, (upto[top - 1] if top else 0) + CHUNK_BYTES, "right")))
            yield texts.slice(top, end - top), [batch.column(k).slice(top, end - top) for k in range(batch.num_columns - 1)]
            top = end


def _batch(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names)


def _count(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(found)
            n = np.array(list(found.values()), "<i8")
            for bucket, at in _blobs(words, buckets):
                yield _batch(["bucket", "words", "n"], bucket, b" ".join([words[i] for i in at]), n[at].tobytes())
            found.clear()

        for batch in batches:
            for texts, _ in _chunks([batch]):
                counted = _words(texts)[0].value_counts()
                found.update(dict(zip(_listed(counted.field(0)), _listed(counted.field(1)), strict=True)))
                if len(found) > COUNTED:
                    yield from flush()
        yield from flush()

    return count


def _add(table: pa.Table) -> pa.Table:
    """A bucket's words with their counts added up."""
    found: Counter[bytes] = Counter()
    for words, n in zip(table.column("words").to_pylist(), table.column("n").to_pylist(), strict=True):
        for w, c in zip(words.split(), np.frombuffer(n, "<i8").tolist(), strict=True):
            found[w] += c
    return pa.table([table.column("bucket").slice(0, 1).combine_chunks(), pa.array([b" ".join(found)], pa.binary()), pa.array([np.array(list(found.values()), "<i8").tobytes()], pa.binary())], names=["bucket", "words", "n"])


def _steps_of(n: np.ndarray) -> np.ndarray:
    """Counts cut to their six highest bits, so that few different ones exist."""
    shift = np.maximum(np.floor(np.log2(n)).astype(np.int64) - 5, 0)
    return n >> shift << shift


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By ending and by step of counts: words and their counts' sum."""
    for batch in batches:
        for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = np.frombuffer(n, "<i8")
            ends = np.array([_ENDINGS[w[-2:]] for w in words.split()], np.int64)
            steps, at = np.unique(_steps_of(n), return_inverse=True) if len(n) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * ENDINGS + [1] * len(steps)), pa.array(np.concatenate([np.arange(ENDINGS), steps])), pa.array(np.concatenate([np.bincount(ends, minlength=ENDINGS), np.bincount(at, minlength=len(steps))])), pa.array(np.concatenate([np.bincount(ends, n, ENDINGS), np.bincount(at, n, len(steps))]).astype(np.int64))],
                ["kind", "key", "words", "n"],
            )


SHAPES = gru.sizes(HEADS * WORDS_EACH + ENDINGS, HEADS + ENDINGS, HEADS, WORDS_EACH)


class Vocabulary:
    """What is broadcast: known words with their counts, and for each its code: a head word's place, or its ending's."""

    def __init__(self, words: list[bytes], n: np.ndarray, ends: int, total: int, different: int, ending_words: np.ndarray, ending_counts: np.ndarray):
        order = np.lexsort((np.arange(len(words)), -n))  # words come sorted
        self.words = [words[i] for i in order]
        n = n[order]
        self.total, self.different = total, different
        size = SMOOTHING * (different + 1) + total
        heads = min(len(n), HEADS * WORDS_EACH - 1)
        self.end_base = np.log10((ends + SMOOTHING) / size)
        self.unseen_base = np.log10(SMOOTHING / size)
        self.base = np.log10((n + SMOOTHING) / size)
        self.ends_known = ends > 0
        own = np.array([ending(w) for w in self.words], np.int64)
        mass = np.maximum(ending_counts + SMOOTHING * ending_words - np.bincount(own[:heads], n[:heads] + SMOOTHING, ENDINGS), 0)
        self.rare = np.log10(mass + SMOOTHING)
        self.size = size
        place = np.arange(1, heads + 1)  # place 0 is the end
        self.code = np.concatenate([place, HEADS * WORDS_EACH + own[heads:]]).astype(np.int16)
        self.inside = np.concatenate([np.zeros(heads), np.log10(n[heads:] + SMOOTHING) - self.rare[own[heads:]]])
        head_mass = np.full(HEADS * WORDS_EACH, 1e-25)  # places without a word
        head_mass[0] = ends + SMOOTHING
        head_mass[1 : heads + 1] = n[:heads] + SMOOTHING
        head_mass = head_mass.reshape(HEADS, WORDS_EACH)
        shares = np.concatenate([head_mass.sum(axis=1), mass + SMOOTHING])
        self.class_share = shares / shares.sum()
        self.word_share = head_mass / head_mass.sum(axis=1, keepdims=True)

    def params(self) -> np.ndarray:
        return gru.new_params(SHAPES, self.class_share, self.word_share)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    @property
    def index(self) -> dict[bytes, int]:
        if "_index" not in self.__dict__:
            self._index = {w: i for i, w in enumerate(self.words)}
        return self._index


_ENCODED = "bucket long, uid long, doc_id long, held_out boolean, share int, n_tokens long, n_known long, base double, inside double, codes binary, words binary, docs binary, n binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
_FIELDS = {x.split()[0]: _KINDS[x.split()[1]] for x in _ENCODED.split(", ")}


def _rows(rows: int, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if f not in values else values[f] if isinstance(values[f], pa.Array) else pa.array(values[f], t) for f, t in _FIELDS.items()], list(_FIELDS))


def _encode(sent: Broadcast, buckets: int):
    """Rows of documents (bucket null): codes, and what known words add to the scores whatever the network says.

    And rows of words whose counts are still to be looked up, by bucket.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        get = vocabulary.index.get
        for texts, (uid, doc_id, held_out, share) in _chunks(batches):
            words, doc = _words(texts)
            coded = words.dictionary_encode()
            distinct, place = _listed(coded.dictionary), coded.indices.to_numpy()
            at = np.fromiter(map(get, distinct, repeat(-1)), np.int64, len(distinct))
            code = vocabulary.code[at] if len(vocabulary.code) else np.zeros(len(at), np.int16)
            new = np.flatnonzero(at < 0)
            code[new] = np.array([HEADS * WORDS_EACH + _ENDINGS[distinct[i][-2:]] for i in new.tolist()], np.int16)
            sizes = np.bincount(doc, minlength=len(texts))
            codes = np.zeros(len(doc) + len(texts), np.int16)  # an end's code is 0
            codes[np.arange(len(doc)) + doc] = code[place]
            at = at[place]
            known = at >= 0
            ends = np.cumsum(sizes + 1).tolist()
            raw = codes.astype("<i2").tobytes()
            per = lambda x: np.bincount(doc[known], x[at[known]], len(texts))
            n_known = np.bincount(doc[known], minlength=len(texts)) + int(vocabulary.ends_known)
            yield _rows(
                len(texts), uid=uid, doc_id=doc_id, held_out=held_out, share=share, n_tokens=sizes + 1, n_known=n_known, base=per(vocabulary.base) + vocabulary.end_base, inside=per(vocabulary.inside),
                codes=[raw[2 * a : 2 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)],
            )
            ids = uid.to_numpy(zero_copy_only=False)
            far = np.flatnonzero(~known)
            pairs, n = np.unique(place[far].astype(np.int64) * len(texts) + doc[far], return_counts=True)
            words = [distinct[i] for i in (pairs // len(texts)).tolist()]
            docs, n = ids[pairs % len(texts)].astype("<i8"), n.astype("<i8")
            if words:
                to, places = zip(*_blobs(words, buckets), strict=True)
                yield _rows(len(to), bucket=to, words=[b" ".join([words[i] for i in k]) for k in places], docs=[docs[k].tobytes() for k in places], n=[n[k].tobytes() for k in places])

    return encode


class Tokens:
    """Documents' codes in lane order: the token before each, whether the state is kept, class (-1: not counted) and place."""

    def __init__(self, docs: list[np.ndarray], segment: int | None = None):
        silent = [0] * len(docs)
        if segment:
            silent = [min(top, WARM) for d in docs for top in range(0, len(d), segment)]
            docs = [d[max(0, top - WARM) : top + segment] for d in docs for top in range(0, len(d), segment)]
        lengths = np.array([len(d) for d in docs], np.int64)
        codes = np.concatenate(docs)
        self.lanes = gru.Lanes(lengths)
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)[self.lanes.order]
        first = np.cumsum(lengths) - lengths
        inputs = np.roll(codes, 1)
        inputs[first] = 0
        keep = np.ones(len(codes), np.float32)
        keep[first] = 0
        head = codes < HEADS * WORDS_EACH
        classes = np.where(head, codes // WORDS_EACH, codes - HEADS * (WORDS_EACH - 1))
        for k in np.flatnonzero(silent).tolist():
            classes[first[k] : first[k] + silent[k]] = -1
        self.of = tuple(x[self.lanes.order] for x in (inputs, keep, classes, np.where(head, codes % WORDS_EACH, 0)))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, pa.RecordBatch]]]:
    """Documents (codes in the first column) to run side by side, each with its row."""
    held: tuple[list, list] = ([], [])
    full = [0, 0]
    for batch in batches:
        others = batch.select(list(range(1, batch.num_columns)))
        for i, x in enumerate(batch.column(0)):
            codes = np.frombuffer(x.as_py(), "<i2")
            kind = len(codes) > LONG
            if full[kind] and full[kind] + len(codes) > CHUNK_TOKENS:
                yield held[kind]
                held[kind].clear()
                full[kind] = 0
            held[kind].append((codes, others.slice(i, 1)))
            full[kind] += len(codes)
    if sum(full) <= CHUNK_TOKENS:  # the few that are left fill the lanes next to the long ones
        held = ([*held[0], *held[1]], [])
    yield from (h for h in held if h)


def _train(sent: Broadcast, rate: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = sent.value.copy()
        params, adam, seen = gru.views(flat, SHAPES), gru.Adam(flat, SHAPES, rate), 0
        for held in _together(batches):
            tokens = Tokens([codes for codes, _ in held], SEGMENT)
            gru.train(params, adam, tokens.lanes, *tokens.of)
            seen += int(np.count_nonzero(tokens.of[2] >= 0))
        if seen:
            task = TaskContext.get().partitionId()
            pieces = range(-(-len(flat) // PIECE))
            n = len(pieces)
            values = [(flat[k * PIECE : (k + 1) * PIECE].astype("<f8") * seen).tobytes() for k in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([task] * n, pa.int64()), pa.array([float(seen)] * n), pa.array(values, pa.binary())], ["piece", "task", "tokens", "values"])

    return train


_MODEL = "piece long, task long, tokens double, values binary"


def _summed(table: pa.Table) -> pa.Table:
    """Pieces of models, added up in the order of their tasks."""
    rows = sorted(zip(table.column("task").to_pylist(), table.column("tokens").to_pylist(), table.column("values").to_pylist(), strict=True))
    total = np.zeros(len(rows[0][2]) // 8)
    for _, _, values in rows:
        total += np.frombuffer(values, "<f8")
    return pa.table([table.column("piece").slice(0, 1).combine_chunks(), pa.array([rows[0][0]], pa.int64()), pa.array([sum(r[1] for r in rows)]), pa.array([total.tobytes()], pa.binary())], names=["piece", "task", "tokens", "values"])


def _score(sent: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = gru.views(sent.value, SHAPES)
        for held in _together(batches):
            tokens = Tokens([codes for codes, _ in held])
            found = np.bincount(tokens.doc, gru.score(params, tokens.lanes, *tokens.of), len(held)) / np.log(10)
            rows = pa.Table.from_batches([row for _, row in held]).combine_chunks().to_batches()[0]
            inside = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(found + inside)], [*rows.schema.names[1:], "score"])

    return score


def _look_up(sent: Broadcast):
    """A bucket's counts and the documents' words in it, to what those words add to each document."""

    def look_up(counts: pa.Table, asked: pa.Table) -> pa.Table:
        vocabulary = sent.value
        known: dict[bytes, int] = {}
        for words, n in zip(counts.column("words").to_pylist(), counts.column("n").to_pylist(), strict=True):
            known.update(zip(words.split(), np.frombuffer(n, "<i8").tolist(), strict=True))
        docs, c, ends, times = [], [], [], []
        for words, d, n in zip(asked.column("words").to_pylist(), asked.column("docs").to_pylist(), asked.column("n").to_pylist(), strict=True):
            words = words.split()
            c += [known.get(w, 0) for w in words]
            ends += [_ENDINGS[w[-2:]] for w in words]
            docs.append(np.frombuffer(d, "<i8"))
            times.append(np.frombuffer(n, "<i8"))
        c = np.array(c, np.int64)
        docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        times = np.concatenate(times) if times else np.zeros(0, np.int64)
        log = np.log10(c + SMOOTHING)
        uid, at = np.unique(docs, return_inverse=True)
        per = lambda x: np.bincount(at, x * times, len(uid)).astype(np.float64)
        added = [per((c > 0).astype(np.int64)).astype(np.int64), per(log - np.log10(vocabulary.size)), per(log - vocabulary.rare[np.array(ends, np.int64)])]
        return pa.table([uid, *added], names=["uid", "more_known", "more_base", "more_score"])

    return look_up


def vocabulary_of(training: DataFrame, buckets: int, ends: int) -> tuple[DataFrame, Vocabulary]:
    """The counts of all words by bucket, and what of them is broadcast."""
    counts = checkpointed(training.select("text").mapInArrow(_count(buckets), _COUNTS).groupBy("bucket").applyInArrow(_add, _COUNTS))
    found = counts.select("words", "n").mapInArrow(_summary, "kind long, key long, words long, n long").groupBy("kind", "key").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()  # a bounded number of keys
    ending_words, ending_counts = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in found:
        if r["kind"] == 0:
            ending_words[r["key"]], ending_counts[r["key"]] = r["words"], r["n"]
    least, room = 1 << 62, KNOWN
    for r in sorted((r for r in found if r["kind"] == 1), key=lambda r: -r["key"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["key"]

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.frombuffer(n, "<i8")
                at = np.flatnonzero(n >= least)
                words = words.split()
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join([words[i] for i in at])], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], ["words", "n"])

    rows = counts.select("words", "n").mapInArrow(frequent, "words binary, n binary").collect()  # at most KNOWN words
    words = [w for r in rows for w in bytes(r["words"]).split()]
    n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in rows]) if rows else np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=words.__getitem__)
    total = int(ending_counts.sum()) + ends
    return counts, Vocabulary([words[i] for i in order], n[order], ends, total, int(ending_words.sum()) + (ends > 0), ending_words, ending_counts)


def encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """The codes of all documents, the counts of all training words, and the vocabulary."""
    spark = docs.sparkSession
    prepare(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    share = F.pmod(F.xxhash64("doc_id"), F.lit(sum(n for n, _ in ROUNDS))).cast("int")
    whole = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), (fold == 0).alias("held_out"), share.alias("share"), F.coalesce("text", F.lit("")).alias("text"))
    training = whole.where(~F.col("held_out"))
    size = whole.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    buckets = max(32, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    counts, vocabulary = vocabulary_of(training, buckets, size["ends"])
    return written(whole.mapInArrow(_encode(spark.sparkContext.broadcast(vocabulary), buckets), _ENCODED)), counts, vocabulary


def trained(codes: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The parameters after all rounds."""
    values, done = vocabulary.params(), 0
    for part, rate in ROUNDS:
        sent = codes.sparkSession.sparkContext.broadcast(values)
        mine = codes.where(F.col("bucket").isNull() & ~F.col("held_out") & (F.col("share") >= done) & (F.col("share") < done + part)).select("codes")
        models = mine.mapInArrow(_train(sent, rate), _MODEL).groupBy("piece", F.floor(F.col("task") / TOGETHER).alias("t")).applyInArrow(_summed, _MODEL)
        values = values.copy()
        for r in models.groupBy("piece").applyInArrow(_summed, _MODEL).collect():  # the model, in pieces
            values[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(bytes(r["values"]), "<f8") / r["tokens"]
        done += part
    return values


def scored(codes: DataFrame, counts: DataFrame, vocabulary: Vocabulary, values: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    sc = codes.sparkSession.sparkContext
    asked = codes.where("bucket is not null").select("bucket", "words", "docs", "n")
    more = counts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up(sc.broadcast(vocabulary)), "uid long, more_known long, more_base double, more_score double")
    more = more.groupBy("uid").agg(F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"), F.sum("more_score").alias("more_score"))
    per_doc = codes.where("bucket is null").select("codes", "inside", "uid", "doc_id", "held_out", "n_tokens", "n_known", "base")
    near = per_doc.mapInArrow(_score(sc.broadcast(values)), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return near.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score")
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    codes, counts, vocabulary = encoded(docs)
    return scored(codes, counts, vocabulary, trained(codes, vocabulary))
