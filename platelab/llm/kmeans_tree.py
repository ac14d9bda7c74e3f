"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is built from a bounded sample and is broadcast (at most ``LEAVES`` leaves); every row is put into the leaf
that it falls into. A query goes through the tree with a priority queue ordered by the inner product with the centres,
until it has seen as many leaves as it may and rows enough for all its neighbours, however small the leaves are. How
many leaves that is, is calibrated: for ``CALIBRATION`` queries the true neighbours are found by comparing them with
all rows, and visits widen until ``RECALL`` of these lie in visited leaves. How far that prunes depends on the vectors:
clustered ones need few leaves, unstructured ones about half of them.

Leaves are packed into blocks of bounded size in the order of the tree, so that near leaves share a block; a leaf with
more rows (many copies of one vector) gets several blocks. A query is sent to the blocks of the leaves it visits only.
Each block holds its rows once and lets the queries that visit it stream past, so a task's memory does not grow.

Defined results: vectors that are null, zero, of another length than most (their product with others is not defined),
or that hold null or non-finite components take no part, nor do rows without vec_id; rows that share a vec_id are rows
of their own, each a candidate of the other, and each asks for itself if its vec_id is divisible; equal scores are
ordered by vec_id; with fewer than ``NEIGHBOURS`` candidates all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepare

NEIGHBOURS = 20
EVERY = 20
SAMPLE = 16_384
LEAVES = 4096
LEAF_ROWS = 128
BRANCHES = 16
CALIBRATION = 256
RECALL = 0.93
#: Bounds of the rows of a block; between them, rows make up about ``BLOCKS`` blocks.
BLOCK_ROWS, BLOCKS = (512, 8192), 24
CHUNK = 256

_FOUND = "query long, query_id long, found array<struct<minus: double, vec_id: long, uid: long>>"
_FOUND_TYPE = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64()), ("uid", pa.int64())]))


class Tree:
    """Centres of all nodes; a node is a leaf or has its children at ``first`` to ``last``."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.centres = [sample.mean(axis=0)]
        self.children: list[tuple[int, int]] = [(0, 0)]
        waiting = [(0, sample)]
        leaves = 1
        while waiting:
            node, rows = waiting.pop(0)
            k = min(BRANCHES, LEAVES - leaves + 1, int(np.ceil(len(rows) / leaf_rows)))
            if k < 2:
                continue
            parts, centres = _kmeans(rows, k)
            if len(centres) < 2:
                continue
            at = len(self.centres)
            self.children[node] = (at, at + len(centres))
            self.centres += list(centres)
            self.children += [(0, 0)] * len(centres)
            leaves += len(centres) - 1
            waiting += [(at + i, rows[parts == i]) for i in range(len(centres))]
        self.centres = np.array(self.centres)
        self.leaves = leaves
        self.leaf = np.full(len(self.children), -1)  # leaves are numbered from left to right
        ahead, number = [0], 0
        while ahead:
            node = ahead.pop()
            a, b = self.children[node]
            if a == b:
                self.leaf[node], number = number, number + 1
            ahead += range(b - 1, a - 1, -1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            a, b = self.children[node]
            if a == b:
                out[at] = self.leaf[node]
                continue
            near = _nearest(rows[at], self.centres[a:b])
            waiting += [(a + i, at[near == i]) for i in range(b - a) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: list[int] | None = None, rows: int = 0) -> list[int]:
        """Leaves in the order in which the priority queue yields them: ``most``, and more until they hold ``rows`` rows."""
        nearness = (-(self.centres @ query)).tolist()
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < rows):
            _, node = heapq.heappop(queue)
            a, b = self.children[node]
            if a == b:
                out.append(int(self.leaf[node]))
                seen += sizes[out[-1]] if sizes else 0
            else:
                for child in range(a, b):
                    heapq.heappush(queue, (nearness[child], child))
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (rows @ centres.T), axis=1)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Parts and centres; centres that stay without rows are left out."""
    centres = rows[np.random.default_rng(len(rows)).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        part = _nearest(rows, centres)
        used, part = np.unique(part, return_inverse=True)
        centres = np.stack([rows[part == i].mean(axis=0) for i in range(len(used))])
    return _nearest(rows, centres), centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _best(scores: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> list[dict]:
    """The best ``k`` of the finite ``scores``, taken again in one order of summation so that equal vectors tie."""
    finite = np.flatnonzero(np.isfinite(scores))
    if len(finite) > k:
        bound = np.partition(scores[finite], len(finite) - k)[len(finite) - k]
        finite = finite[scores[finite] >= bound - 1e-9 * max(1.0, abs(bound))]
    exact = (vectors[finite] * query).sum(axis=1)
    order = np.lexsort((uids[finite], ids[finite], -exact))[:k]
    return [{"minus": -float(exact[i]), "vec_id": int(ids[finite[i]]), "uid": int(uids[finite[i]])} for i in order]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of what was found for each query anywhere."""
    return found.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    size = F.size("embedding")
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = fine.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    lengths = fine.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(size == (lengths["n"] if lengths else -1))


def _pack(column: pa.Array) -> pa.Array:
    width = len(column[0]) if len(column) else 0
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "<f8").tobytes()
    return pa.array([flat[i : i + 8 * width] for i in range(0, len(flat), 8 * width)] if width else [], pa.binary())


def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found for each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors)
    n = rows.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    sample = rows.where(share < min(1 << 20, -(-SAMPLE * (1 << 20) // max(1, n)))).orderBy("vec_id").limit(2 * SAMPLE).select("embedding").toArrow()
    width = len(sample.column(0)[0]) if sample.num_rows else 1
    points = sample.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if sample.num_rows else np.zeros((1, width))
    tree = spark.sparkContext.broadcast(Tree(points, max(2.0, max(LEAF_ROWS, n / LEAVES) * len(points) / max(1, n))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = _pack(batch.column(2))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, pa.array(tree.value.place(_matrix(packed)))], ["uid", "vec_id", "vector", "leaf"])

    placed = checkpointed(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding").mapInArrow(place, "uid long, vec_id long, vector binary, leaf long"))
    queries = placed.where(F.col("vec_id") % every == 0)
    asked = queries.count()
    some = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < min(1 << 20, -(-CALIBRATION * (1 << 20) // max(1, asked)))).select("uid", "vec_id", "vector").orderBy("vec_id", "uid").limit(2 * CALIBRATION).toArrow()
    most = _calibrated(placed, tree.value, some, k, recall)
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most LEAVES rows
    most_rows = max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], n // BLOCKS))
    first, parts, block, full = {}, {}, 0, 0
    for leaf in sorted(sizes):
        if full and full + sizes[leaf] > most_rows:
            block, full = block + 1, 0
        first[leaf], parts[leaf] = block, max(1, -(-sizes[leaf] // most_rows))
        block += parts[leaf] - 1
        full = full + sizes[leaf] if parts[leaf] == 1 else most_rows
    leaves = tree.value.leaves
    held = [sizes.get(leaf, 0) for leaf in range(leaves)]
    names = ["block", "kind", "uid", "vec_id", "vector", "leaves"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, leaf = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            to = np.array([first[x] + i * 0x9E3779B1 % parts[x] if parts[x] > 1 else first[x] for i, x in zip(uids.tolist(), leaf.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.zeros(len(to), np.int64)), *batch.columns[:3], pa.array([int(x).to_bytes(8, "little") for x in leaf], pa.binary())], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, vec_id, vector in zip(*batch.columns, strict=True):
                by: dict[int, list[int]] = {}
                for leaf in tree.value.visits(np.frombuffer(vector.as_py(), "<f8"), most, held, k + 1):
                    for b in range(first.get(leaf, 0), first.get(leaf, 0) + parts.get(leaf, 0)):
                        by.setdefault(b, []).append(leaf)
                m = len(by)
                values = [list(by), [1] * m, [uid.as_py()] * m, [vec_id.as_py()] * m, [vector.as_py()] * m, [np.array(v, "<i8").tobytes() for v in by.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c < 4 else pa.binary()) for c, v in enumerate(values)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        held: list = []
        ready = None
        for batch in batches:
            at, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if at[a] != block:
                    block, held, ready = at[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4)), np.frombuffer(b"".join(part.column(5).to_pylist()), "<i8")))
                    continue
                if ready is None and held:
                    uids, ids, vecs, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(leaf, kind="stable")
                    ready = uids[order], ids[order], vecs[order], leaf[order]
                for top in range(0, part.num_rows, CHUNK):
                    yield _answers(part.slice(top, CHUNK), ready, leaves, k)

    kinds = "block long, kind long, uid long, vec_id long, vector binary, leaves binary"
    both = placed.mapInArrow(own, kinds).union(queries.select("uid", "vec_id", "vector").mapInArrow(ask, kinds))
    found = both.repartition(max(8, block + 1), "block").sortWithinPartitions("block", "kind").mapInArrow(meet, _FOUND)
    ranked = _merged(found, k).select("query_id", F.posexplode("found").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.minus")).alias("score"))


def _answers(part: pa.RecordBatch, ready: tuple | None, leaves: int, k: int) -> pa.RecordBatch:
    """What the queries of ``part`` find in a block's rows."""
    asked, names, points = part.column(2).to_numpy(), part.column(3), _matrix(part.column(4))
    out: list[list[dict]] = [[] for _ in asked]
    if ready is not None:
        uids, ids, vectors, leaf = ready
        wanted = np.zeros((len(asked), leaves), bool)
        for i, x in enumerate(part.column(5).to_pylist()):
            wanted[i, np.frombuffer(x, "<i8")] = True
        scores = np.full((len(asked), len(ids)), -np.inf)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            who = np.flatnonzero(wanted[:, leaf[a]])
            if len(who):
                scores[who, a:b] = points[who] @ vectors[a:b].T
        for i, q in enumerate(asked):
            scores[i, uids == q] = -np.inf
            out[i] = _best(scores[i], points[i], vectors, ids, uids, k)
    return pa.RecordBatch.from_arrays([pa.array(asked), names, pa.array(out, _FOUND_TYPE)], ["query", "query_id", "found"])


def exact(placed: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries (uid, vec_id, vector), by comparing them with every row."""
    who, names, points = asked.column("uid").to_numpy(), asked.column("vec_id").to_numpy(), _matrix(asked.column("vector").combine_chunks())
    sent = placed.sparkSession.sparkContext.broadcast((who, names, points))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, names, q = sent.value
        for batch in batches:
            if batch.num_rows:
                uids, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                scores = q @ vectors.T
                scores[who[:, None] == uids[None]] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(names), pa.array([_best(scores[i], q[i], vectors, ids, uids, k) for i in range(len(who))], _FOUND_TYPE)], ["query", "query_id", "found"])

    return _merged(placed.select("uid", "vec_id", "vector").mapInArrow(compare, _FOUND), k)


def _calibrated(placed: DataFrame, tree: Tree, some: pa.Table, k: int, recall: float) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours of the calibration queries are reached."""
    if not some.num_rows:
        return 1
    true = exact(placed, some, k).select("query", F.explode("found").alias("x")).select("query", F.col("x.uid").alias("uid"))
    where = placed.select("uid", "leaf").join(F.broadcast(true), "uid").select("query", "leaf").collect()  # CALIBRATION x k rows
    points = _matrix(some.column("vector").combine_chunks())
    turn = {i: {leaf: t for t, leaf in enumerate(tree.visits(p, tree.leaves))} for i, p in zip(some.column("uid").to_pylist(), points, strict=True)}
    needed = sorted(turn[r["query"]][r["leaf"]] + 1 for r in where)
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
