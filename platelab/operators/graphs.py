"""Connected components, and clusters of vectors that are alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelab.session import checkpointed, ship


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v long) to (node, root): root is the least node that can be reached; only nodes with an edge appear.

    Rounds of label exchange over what is left: every node points to the least neighbour that it knows, and edges are
    rewritten to these. A node's row is dealt by the node, so the largest star is joined by its leaves' keys.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        # every larger neighbour of a node is tied to the least node around it
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        tied = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # and every smaller neighbour to the least of them
        low = tied.groupBy("u").agg(F.min("v").alias("m"))
        down = tied.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = checkpointed(down.where("u <> v").distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _forest(near: np.ndarray, rows: np.ndarray, columns: np.ndarray, same: bool) -> tuple[list[int], list[int]]:
    """Of all links between rows and columns, as few as keep the same connected."""
    at = len(rows) * (not same)
    group = np.arange(at + len(columns))
    us, vs = [], []
    for i in np.flatnonzero(near.any(axis=1)):
        met = np.flatnonzero(near[i])
        of, first = np.unique(group[at + met], return_index=True)
        new = of != group[i]
        if new.any():
            us += [int(rows[i])] * int(new.sum())
            vs += columns[met[first[new]]].tolist()
            joined = np.append(of, group[i])
            group[np.isin(group, joined)] = joined.min()
    return us, vs


def similar_vectors(rows: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """Links (u, v) that connect all rows (idx, key, vector of unit length) of one key with a cosine of at least
    ``threshold``; of all such pairs only a spanning forest of each pair of tiles.

    A key's rows are dealt into tiles of bounded size, so a key that most rows share is many tasks.
    """
    ship(rows.sparkSession)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    tiles = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    dealt = rows.select("idx", F.struct("key").alias("key"), F.col("vector").cast("array<double>").alias("vector")).join(sizes.select(F.struct("key").alias("key"), tiles.alias("tiles")), "key")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("idx"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("key", "tile", "tiles").agg(F.collect_list(F.struct("idx", "vector")).alias("rows"))
    sent = packed.select("key", "tile", "rows", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    work = sent.groupBy("key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q")).agg(F.sort_array(F.collect_list(F.struct("tile", "rows"))).alias("sides")).select("sides")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                held = []
                for side in row:
                    x = side["rows"].values
                    ids = x.field("idx").to_numpy()
                    held.append((ids, x.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
                (i, a), (j, b) = held[0], held[-1]
                near = a @ b.T >= threshold
                if len(held) == 1:
                    near = np.triu(near, 1)
                us, vs = _forest(near, i, j, len(held) == 1)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return work.mapInArrow(compare, "u long, v long")


def semantic_merge(rows: DataFrame, threshold: float = 0.86, block: int = 2048) -> DataFrame:
    """idx, root and members of each row (idx, key, count, vector of unit length): rows of one key that are alike, also
    by way of others, become one cluster under its most frequent member, ties under the smallest idx.

    Rows without vector or key stand alone. Chains can join what is not alike; that is this merge's nature, and why it is
    off unless asked for.
    """
    known = rows.where(F.col("vector").isNotNull() & F.col("key").isNotNull())
    found = connected_components(similar_vectors(known, threshold, block))
    named = rows.select("idx", "count").join(found.withColumnRenamed("node", "idx"), "idx", "left").select("idx", "count", F.coalesce("root", "idx").alias("component"))
    # the members of a component are summed up before its name goes back to them
    heads = named.groupBy("component").agg(F.min_by("idx", F.struct((-F.col("count")).alias("c"), "idx")).alias("root"), F.count("*").alias("members"))
    return named.join(heads, "component").select("idx", "root", "members")
