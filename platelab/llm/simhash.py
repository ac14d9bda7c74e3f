"""Near-duplicates by SimHash: tiled exact comparison of 64-bit fingerprints.

Fingerprints are dealt into tiles of one population count. Two fingerprints that differ in at most ``RADIUS`` bits
have counts that differ by no more, so tiles further apart are never paired. Within a pair of tiles, numpy compares
blocks with exclusive-or and bit counts, skipping blocks whose counts per 16-bit quarter are too far apart. A pair of
tiles returns a spanning forest of its links, never all of them, so that groups of copies cost no more than their size.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer than
``WORDS`` words are one shingle; repeated rows share fingerprint and component; a null doc_id is never a
component_id unless its whole component has none; very long texts are hashed whole, in one task each; an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpointed, nested, prepare
from .components import connected_components
from .components import union as _union

WORDS = 3
SEED = 42
RADIUS = 3
TILE = 65_536
BLOCK = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash: bit b is 1 if it is 1 in more than half of the shingles' hashes."""
    found = as_bytes(text).lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprinted(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py(), words) for x in texts], np.uint64).view(np.int64))

    return of(text)


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``x`` in blocks of like quarter counts (the last place repeats as filling), values, least and most counts."""
    counts = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    at = np.concatenate([order, np.repeat(order[-1:], -len(order) % BLOCK)]).reshape(-1, BLOCK)
    return at, x[at], counts[at].min(axis=1), counts[at].max(axis=1)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links between ``a`` and ``b`` (or within ``a``, if b is None)."""
    nodes = a if b is None else np.concatenate([a, b])
    label = np.arange(len(nodes))
    at_a, in_a, low_a, high_a = _blocks(a)
    at_b, in_b, low_b, high_b = (at_a, in_a, low_a, high_a) if b is None else _blocks(b)
    if b is not None:
        at_b = at_b + len(a)
    step = max(1, (1 << 21) // max(1, len(in_b)))
    for top in range(0, len(in_a), step):
        gap = np.maximum(low_a[top : top + step, None] - high_b[None], low_b[None] - high_a[top : top + step, None])
        near, with_ = np.nonzero(np.maximum(gap, 0).sum(axis=2) <= radius)
        near += top
        if b is None:
            near, with_ = near[with_ >= near], with_[with_ >= near]
        for k in range(0, len(near), 512):
            i, j = near[k : k + 512], with_[k : k + 512]
            close = np.bitwise_count(in_a[i][:, :, None] ^ in_b[j][:, None, :]) <= radius
            n, p, q = np.nonzero(close)
            if len(n):
                _union(label, at_a[i[n], p], at_b[j[n], q])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct ``fp`` (long) to edges (u, v) that connect exactly what links within ``radius`` connect."""
    of = fingerprints.select("fp", F.bit_count("fp").alias("p"))
    parts = {r["p"]: max(1, -(-r["count"] // tile)) for r in of.groupBy("p").count().collect()}  # at most 65 rows
    first = {}
    total = 0
    for p in range(65):
        first[p] = total
        total += parts.get(p, 0)
    first |= {p: 0 for p in range(-radius, 0)} | {p: total for p in range(65, 66 + radius)}
    table = lambda f: F.element_at(F.array(*[F.lit(f(p)) for p in range(65)]), F.col("p") + 1)
    tiles = (
        of.withColumn("tile", table(lambda p: first[p]) + F.pmod(F.xxhash64("fp"), table(lambda p: parts.get(p, 1))).cast("int"))
        .groupBy("p", "tile")
        .agg(F.collect_list("fp").alias("fps"))
        .select("tile", "fps", F.explode(F.sequence(table(lambda p: first[p - radius]), table(lambda p: max(first[p + radius + 1] - 1, 0)))).alias("other"))
    )
    pairs = tiles.groupBy(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).agg(F.collect_list(F.struct("tile", "fps")).alias("sides"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                sides = [np.asarray(s["fps"].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for s in row]
                u, v = tile_forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return pairs.select("sides").mapInArrow(compare, "u long, v long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` with columns doc_id and fp gain ``component_id`` and ``root``, which names the component; other columns stay."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct, radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prepare(docs.sparkSession)
    rows = checkpointed(docs.select("doc_id", fingerprinted(F.col("text")).alias("fp")))
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, own: Column, placed: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each root of ``placed`` (doc_id, own, root); ``own`` is a hash of the whole row."""
    stay = placed.groupBy("root").agg(F.min(F.struct("doc_id", "own")).alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.own").alias("at"))
    marked = nested(docs, F.col("doc_id"), own.alias("own"))
    kept = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("at")), "left_semi")
    return kept.dropDuplicates(["doc_id", "own"]).select("row.*")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each component: the one of the smallest doc_id, ties by a hash of the whole row."""
    prepare(docs.sparkSession)
    own = whole_row(docs)
    rows = checkpointed(docs.select("doc_id", own.alias("own"), fingerprinted(F.col("text"), words).alias("fp")))
    return one_of_each(docs, own, classes(rows))
