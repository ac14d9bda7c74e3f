"""Removal of repeated passages: every byte that a window of ``WINDOW`` bytes covers which also starts earlier.

1. Each window belongs to its anchor, the gram of ``GRAM`` bytes in it that hashes least (the leftmost of equal ones).
   Windows in a row with one anchor make a stretch. Equal windows have equal anchors, so each anchor's group can be
   judged by itself.
2. Stretches meet in buckets of anchors. Of stretches that are equal throughout, all but the first are repeats.
   Batches see to their own ones first, so a common passage reaches its bucket once per batch.
3. Where an anchor has stretches that differ, a run-length Burrows-Wheeler index of its group streams each stretch
   away from the anchor and finds which windows occur in an earlier stretch (see ``run_index``).
4. Anchors that would make too large a group are known from a count beforehand; each of their windows becomes a
   stretch of its own, named by 128 bits of its digest, which any number of tasks can share.

"Earlier" means a smaller doc_id, or an earlier start in the same document. Defined results: null text is empty; a
null doc_id comes before all others; rows that share a doc_id stand in the order of a hash of their text, and rows
that agree in both are one document and get the same result; texts shorter than a window lose nothing; very long
texts are taken apart whole, in one task each, their stretches go to all buckets; an empty table gives an empty result;
other columns are ignored by ``repeats`` and kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freeing, freeing_group, nested, prepare, turn_to
from .run_index import first_windows

WINDOW = 100
GRAM = 24
#: Bytes of text whose stretches make up a bucket, on average.
BUCKET_BYTES = 32 << 20
#: Stretches of one slot of anchors beyond which its windows are told apart by digest.
HOT_ROWS = 25_000
#: Bytes of contexts that one index takes in, but for a single group.
INDEX_BYTES = 1 << 20

_STEP = 1 << 18
_REST = (1 << 20) - 1
_FIELDS = (("doc", "<i8"), ("none", "u1"), ("tie", "<i8"), ("h", "<u8"), ("g", "<u8"), ("p", "<u4"), ("off", "u1"), ("len", "u1"))
_ROWS = "bucket long, " + ", ".join(f"{n} binary" for n, _ in _FIELDS)
_OF_DOC = "doc long, tie long, gone binary, kept binary"
_REP = np.dtype([("h", "<u8"), ("p", "<u4"), ("off", "u1"), ("len", "u1")])
_CONTEXTS = "bucket long, doc binary, none binary, tie binary, h binary, p binary, off binary, len binary, text binary"


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, and where each begins and ends."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``GRAM`` bytes."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(min(8, n)):
        eight[k::8] = np.frombuffer(raw, "<u8", (n - k + 7) // 8, k)
    n = len(data) - GRAM + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += eight[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First windows, places after their last bytes, anchors and anchors' hashes of all stretches, part by part."""
    grams = WINDOW - GRAM + 1
    starts = np.arange(0, max(0, len(data) - WINDOW + 1), _STEP)
    for top in starts:
        part = data[top : top + _STEP + WINDOW - 1]
        h = _gram_hashes(part)
        least = (h & np.uint64(~_REST & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(h) - grams + 1], least[grams - span : grams - span + len(h) - grams + 1])
        at = np.arange(top, top + len(least))
        ok = at + WINDOW <= ends[np.searchsorted(ends, at, "right")] if len(at) else np.zeros(0, bool)
        anchor = np.where(ok, (least & np.uint64(_REST)).astype(np.int64), -1)
        turns = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], turns])
        last = np.concatenate([turns, [len(anchor)]]) - 1
        real = anchor[first] >= 0
        first, last = first[real], last[real]
        a = anchor[first]
        yield first + top, last + top + WINDOW, a + top, h[a]


def _count_slots(slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for _, _, _, h in stretches(*_texts(batch.column(0))):
                at, n = np.unique(h % np.uint64(slots), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]].astype(np.int64))], ["slot", "n"])

    return count


def _per_doc(doc: np.ndarray, none: np.ndarray, tie: np.ndarray, values: np.ndarray) -> tuple[list, list, list]:
    """Group rows of bytes by document: ids, ties and each document's bytes."""
    order = np.lexsort((tie, doc, none))
    doc, none, tie, values = doc[order], none[order], tie[order], values[order]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (none[1:] != none[:-1]) | (tie[1:] != tie[:-1])) + 1
    tops = np.concatenate([[0], cuts]) if len(doc) else np.zeros(0, np.int64)
    ids = [None if none[t] else int(doc[t]) for t in tops]
    return ids, tie[tops].tolist(), [v.tobytes() for v in np.split(values, cuts)] if len(doc) else []


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.stack([start, end], axis=1).astype("<u4")


def _not_first(keys: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by keys, then own; returns the order and which rows repeat the keys of an earlier row that is another's own."""
    order = np.lexsort([*own[::-1], *keys[::-1]])
    differs = lambda cols: np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in cols], axis=0)]) if len(order) else np.zeros(0, bool)
    new = differs(keys)
    tops = np.flatnonzero(new)
    leader = order[tops[np.cumsum(new) - 1]] if len(order) else order
    return order, ~np.all([c[order] == c[leader] for c in own], axis=0) if len(order) else new


def _deal(buckets: int, slots: int, hot: frozenset[int]):
    """Stretches of a batch, dealt to buckets; repeats within the batch go along as spans only."""
    hot_slots = np.array(sorted(hot), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _texts(batch.column(2))
            ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            tie = batch.column(1).to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            s, e, p, h, g, slot = [], [], [], [], [], []
            for first, last, anchor, hashes in stretches(data, ends):
                at = (hashes % np.uint64(slots)).astype(np.int64)
                if len(hot_slots) and (is_hot := np.isin(at, hot_slots)).any():
                    each = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(first[is_hot], last[is_hot], strict=True)])
                    names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[k : k + WINDOW]) for k in each]), "<u8").reshape(-1, 2)
                    keep = ~is_hot
                    first, last = np.concatenate([first[keep], each]), np.concatenate([last[keep], each + WINDOW])
                    anchor, hashes = np.concatenate([anchor[keep], each]), np.concatenate([hashes[keep], names[:, 0]])
                    at = np.concatenate([at[keep], (names[:, 0] % np.uint64(slots)).astype(np.int64)])
                    digests = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first[: keep.sum()].tolist(), last[: keep.sum()].tolist(), strict=True)]
                    g.append(np.concatenate([np.array(digests, np.uint64), names[:, 1]]))
                else:
                    g.append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64))
                s.append(first), e.append(last), p.append(anchor), h.append(hashes), slot.append(at)
            if not s:
                continue
            s, e, p, h, g, slot = map(np.concatenate, (s, e, p, h, g, slot))
            row = np.searchsorted(ends, s, "right") - 1
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((tie, ids, 1 - none))] = np.arange(len(ids))
            base = ends[row]
            order, again = _not_first([h, g], [none[row], ids[row], tie[row], p - base, s - base])
            gone, order = order[again], order[~again]
            if len(gone):
                r = row[gone]
                docs, ties, spans = _per_doc(ids[r], none[r], tie[r], _spans(s[gone] - base[gone], e[gone] - base[gone]))
                a = np.array([d or 0 for d in docs], "<i8")
                for k in range(0, len(docs), 4096):
                    cut = slice(k, k + 4096)
                    yield _row(-1 - (k + len(docs)) % buckets, a[cut], np.array([d is None for d in docs[cut]], np.uint8), np.array(ties[cut], "<i8"), b"".join(spans[cut]), np.array([len(x) // 8 for x in spans[cut]], "<u8"))
            to = slot[order] % buckets
            order = order[np.argsort(to, kind="stable")]
            to = slot[order] % buckets
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            for part in np.split(order, cuts):
                if len(part):
                    r = row[part]
                    cols = (ids[r], none[r], tie[r], h[part], g[part], p[part] - base[part], p[part] - s[part], e[part] - s[part])
                    yield pa.RecordBatch.from_arrays([pa.array([int(slot[part[0]] % buckets)], pa.int64()), *[pa.array([c.astype(t).tobytes()], pa.binary()) for c, (_, t) in zip(cols, _FIELDS, strict=True)]], ["bucket", *[n for n, _ in _FIELDS]])

    return deal


def _row(bucket: int, doc: np.ndarray, none: np.ndarray, tie: np.ndarray, spans: bytes, counts: np.ndarray) -> pa.RecordBatch:
    """Spans of documents on their way through the buckets: in place of hashes there are counts and spans."""
    values = [doc.tobytes(), none.tobytes(), tie.tobytes(), counts.tobytes(), spans, b"", b"", b""]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], ["bucket", *[n for n, _ in _FIELDS]])


def _of_docs(gone: tuple[list, list, list], kept: tuple[list, list, list]) -> pa.Table:
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("gone", pa.binary()), ("kept", pa.binary())])
    n, m = len(gone[0]), len(kept[0])
    return pa.table([gone[0] + kept[0], gone[1] + kept[1], gone[2] + [None] * m, [None] * n + kept[2]], schema=schema)


def _meet(table: pa.Table) -> pa.Table:
    """A bucket: spans of stretches that repeat, and by document the stretches whose anchor has others that differ."""
    col = {n: b"".join(table.column(n).to_pylist()) for n, _ in _FIELDS}
    if table.column("bucket")[0].as_py() < 0:
        counts = np.frombuffer(col["h"], "<u8").astype(np.int64)
        spans = np.frombuffer(col["g"], np.uint8)
        parts = np.split(spans, np.cumsum(counts * 8)[:-1])
        none = np.frombuffer(col["none"], np.uint8)
        ids = [None if n else int(d) for d, n in zip(np.frombuffer(col["doc"], "<i8"), none, strict=True)]
        return _of_docs((ids, np.frombuffer(col["tie"], "<i8").tolist(), [p.tobytes() for p in parts]), ([], [], []))
    doc, none, tie, h, g, p, off, length = (np.frombuffer(col[n], t) for n, t in _FIELDS)
    start = p.astype(np.int64) - off
    before = 1 - none.astype(np.int8)  # null ids come first
    order, again = _not_first([h, g], [before, doc, tie, p, start])
    gone = order[again]
    first = order[~again]
    first = first[np.concatenate([[True], np.any([c[first[1:]] != c[first[:-1]] for c in (h, g, none, doc, tie, p, off)], axis=0)])] if len(first) else first
    runs = np.concatenate([[0], np.flatnonzero(h[first[1:]] != h[first[:-1]]) + 1]) if len(first) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([runs, [len(first)]]))
    mixed = first[np.repeat(size > 1, size)]
    reps = np.zeros(len(mixed), _REP)
    for n, c in (("h", h), ("p", p), ("off", off), ("len", length)):
        reps[n] = c[mixed]
    return _of_docs(_per_doc(doc[gone], none[gone], tie[gone], _spans(start[gone], start[gone] + length[gone])), _per_doc(doc[mixed], none[mixed], tie[mixed], reps))


def _contexts(buckets: int):
    """Texts with the list of their stretches that need comparing, to those stretches' bytes by bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _texts(batch.column(2))
            raw = data.tobytes()
            rows = []
            for i, lists in enumerate(batch.column(3)):
                rep = np.frombuffer(b"".join(lists.as_py()), _REP)
                rows.append((np.full(len(rep), i), rep))
            if not rows:
                continue
            at = np.concatenate([r[0] for r in rows])
            rep = np.concatenate([r[1] for r in rows])
            ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)[at]
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)[at]
            tie = batch.column(1).to_numpy(zero_copy_only=False)[at]
            start = ends[at] + rep["p"] - rep["off"]
            to = (rep["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(part):
                    text = b"".join([raw[a : a + n] for a, n in zip(start[part].tolist(), rep["len"][part].tolist(), strict=True)])
                    values = [ids[part].tobytes(), none[part].tobytes(), tie[part].tobytes(), *[rep[n][part].tobytes() for n in ("h", "p", "off", "len")], text]
                    names = ["bucket", "doc", "none", "tie", "h", "p", "off", "len", "text"]
                    yield pa.RecordBatch.from_arrays([pa.array([int(to[part[0]])], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names)

    return cut


def _compare(table: pa.Table) -> pa.Table:
    """A bucket of contexts, to the spans of their windows that occur in an earlier context."""
    col = {n: b"".join(table.column(n).to_pylist()) for n in ("doc", "none", "tie", "h", "p", "off", "len", "text")}
    kinds = dict(_FIELDS)
    doc, none, tie, h, p, off, length = (np.frombuffer(col[n], kinds[n]) for n in ("doc", "none", "tie", "h", "p", "off", "len"))
    ends = np.cumsum(length, dtype=np.int64)
    order = np.lexsort((p, tie, doc, 1 - none.astype(np.int8), h))
    sizes = np.cumsum(length[order], dtype=np.int64)
    heads = np.concatenate([[0], np.flatnonzero(h[order[1:]] != h[order[:-1]]) + 1])
    cuts, full = [], 0  # whole groups go together while they fit
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        if a and sizes[b - 1] - full > INDEX_BYTES:
            cuts.append(a)
            full = int(sizes[a - 1])
    rows, spans = [], []
    for part in np.split(order, cuts):
        texts = [col["text"][ends[i] - length[i] : ends[i]] for i in part.tolist()]
        for i, seen in zip(part.tolist(), first_windows(h[part], texts, off[part].astype(np.int64), WINDOW), strict=True):
            if seen.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[0], seen.astype(np.int8), [0]])))
                begin = int(p[i]) - int(off[i])
                rows += [i] * (len(turns) // 2)
                spans.append(_spans(begin + turns[0::2], begin + turns[1::2] - 1 + WINDOW))
    rows = np.array(rows, np.int64)
    found = np.concatenate(spans) if spans else np.zeros((0, 2), "<u4")
    return _of_docs(_per_doc(doc[rows], none[rows], tie[rows], found), ([], [], []))


def _merged(lists: list[bytes] | None) -> np.ndarray:
    """Spans of a document, in order and without overlaps or adjoining ends."""
    spans = np.frombuffer(b"".join(lists or ()), "<u4").reshape(-1, 2).astype(np.int64)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1)


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def _tie(docs: DataFrame) -> Column | None:
    """What orders rows of one doc_id; None if no doc_id repeats."""
    return None if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))


def spans(docs: DataFrame) -> tuple[DataFrame, Column, DataFrame]:
    """Bytes to remove: (doc, tie, spans) with a list of packed spans for each document that has any; the tie; and all
    texts as (doc, tie, text): a join of these with the spans takes the shuffle of texts that the spans have come from."""
    prepare(docs.sparkSession)
    repeated = _tie(docs)
    tie = F.lit(0).cast("long") if repeated is None else repeated
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_BYTES))
    slots = 1 << min(24, max(16, (total // 40_000).bit_length()))
    most = max(HOT_ROWS, 8 * total // (39 * slots))
    counts = whole.select("text").mapInArrow(freeing(_count_slots(slots)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    hot = frozenset(r[0] for r in counts.where(F.col("n") > most).select("slot").collect())  # fewer than all stretches / most
    dealt = whole.mapInArrow(freeing(_deal(buckets, slots, hot)), _ROWS)
    met = checkpointed(dealt.groupBy("bucket").applyInArrow(freeing_group(_meet), _OF_DOC))
    wanted = met.where("kept is not null").groupBy("doc", "tie").agg(F.collect_list("kept").alias("kept")).withColumnsRenamed({"doc": "d", "tie": "t"})
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    distinct = whole if repeated is None else whole.dropDuplicates(["doc", "tie"])
    contexts = distinct.join(wanted, same).select("doc", "tie", "text", "kept").mapInArrow(freeing(_contexts(buckets)), _CONTEXTS)
    compared = contexts.groupBy("bucket").applyInArrow(freeing_group(_compare), _OF_DOC)
    gone = met.where("gone is not null").select("doc", "tie", "gone").union(compared.select("doc", "tie", "gone"))
    return gone.groupBy("doc", "tie").agg(F.collect_list("gone").alias("spans")), tie, whole


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and a digest of the bytes that stay."""
    gone, _, whole = spans(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, digest = [], [], [], []
            for text, lists in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                found = _merged(lists.as_py())
                size.append(len(raw))
                removed.append(int((found[:, 1] - found[:, 0]).sum()))
                runs.append(len(found))
                digest.append(hashlib.sha256(kept_bytes(raw, found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    gone = gone.withColumnsRenamed({"doc": "d", "tie": "t"})
    joined = whole.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left").select(F.col("doc").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(freeing(judge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the bytes that stay as text; bytes of characters cut in two are left out, n_chars follows."""
    gone, tie, _ = spans(docs)

    @F.arrow_udf("string")
    def left(texts: pa.Array, lists: pa.Array) -> pa.Array:
        turn_to("repeats")
        return pa.array([t.as_py() if not s.is_valid or not t.is_valid else kept_bytes(t.as_py().encode("utf-8", "replace"), _merged(s.as_py())).decode("utf-8", "ignore") for t, s in zip(texts, lists, strict=True)], pa.string())

    d = nested(docs, F.col("doc_id"), tie.alias("t"), F.col("text")).alias("d")
    g = gone.alias("g")
    joined = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc")) & (F.col("d.t") == F.col("g.tie")), "left").select("d.row", left(F.col("d.text"), F.col("g.spans")).alias("rest"))
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
