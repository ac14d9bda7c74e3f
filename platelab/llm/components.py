"""Connected components of a graph of integer nodes: stars of bounded parts, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freeing, prepare

#: Edges that a task takes together; a graph of no more is done at once.
TOGETHER = 1 << 17


def union(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the sets of u and v; ``label`` holds each node's least member so far."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label[:] = above


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges but the least ones of their components, each with the least one of its own."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    union(label, at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if held and sum(len(u) for u, _ in held) + len(batch) > TOGETHER:
            yield flush()
        held.append(tuple(c.to_numpy() for c in batch.columns))
    if held:
        yield flush()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v long) to (node, root): root is the least node that can be reached.

    Only nodes with an edge to another node appear. Edges are made into stars part by part, which is all if one part
    holds them. Else each round costs two aggregations and two joins over the edges that are left, which are at most one
    per node once the stars have formed; rounds grow with the logarithm of the longest path. Nothing but a count and a
    checksum reaches the driver.
    """
    prepare(edges.sparkSession)
    given = checkpointed(edges.where("u <> v").select("u", "v"))
    parts = -(-given.count() // TOGETHER)
    starred = given.coalesce(max(1, parts)).mapInArrow(freeing(_starred), "u long, v long")
    now = checkpointed(starred if parts <= 1 else starred.distinct())
    state = _state(now) if parts > 1 else (0, 0)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
