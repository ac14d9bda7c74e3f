"""Hierarchical clustering in rounds: the tree of Ward's linkage, its cuts, and groups by average linkage.

Both linkages are reducible: when two groups merge, no third gets nearer to them than it was to the nearer one. So all
pairs of groups that are each other's nearest can merge in one round, and the tree is the one that merging the least
distance first would make. Ties of distance are settled by the groups' least members, which makes the order of pairs
total, and the nearest pair of all is always one that merges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelab.session import checkpointed, ship

from .cleaning import numbered
from .flexibility import _block_pairs

#: So many groups are left to one task at the end, where a round has little work for more.
BLOCK = 1024
#: Nodes made in a round have ids from (round << ROUND) on; leaves have their place.
ROUND = 40
_ROW = "rep long, node long, size long, height double, vector array<double>"
_MERGE = "node long, a long, b long, height double, size long"


def _distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Twice the growth of the squared error if a row of ``a`` merges with one of ``b``; the same both ways round."""
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        d += step * step
    return d * (2 * (na[:, None] * nb[None]) / (na[:, None] + nb[None]))


def _least(d: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each row and whose it is; of equals the pair that comes first."""
    best = d.min(axis=1)
    low, high = np.minimum(own[:, None], other), np.maximum(own[:, None], other)
    tied = d == best[:, None]
    low = np.where(tied, low, np.iinfo(np.int64).max)
    tied &= low == low.min(axis=1)[:, None]
    return best, other[np.where(tied, high, np.iinfo(np.int64).max).argmin(axis=1)]


def _block(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rep = rows.field("rep").to_numpy()
    return rep, rows.field("size").to_numpy().astype(float), rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)


def _mutual(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and ``_distances`` of all pairs that can be the nearest of their row or of their column.

    A matrix product gives all distances but for a rounding error that has a bound; only pairs within it of the least are
    computed as ``_distances`` does.
    """
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    weight = 2 * (na[:, None] * nb[None]) / (na[:, None] + nb[None])
    error = (sa[:, None] + sb[None]) * weight
    about = a @ b.T
    about *= -2 * weight
    about += error
    error *= 8 * (a.shape[1] + 8) * np.finfo(float).eps
    about[own[:, None] == other[None]] = np.inf
    most = about + error
    about -= error
    p, q = np.nonzero((about <= most.min(axis=1)[:, None]) | (about <= most.min(axis=0)[None]))
    p, q = p[own[p] != other[q]], q[own[p] != other[q]]
    d = np.zeros(len(p))
    for k in range(a.shape[1]):
        step = a[p, k] - b[q, k]
        d += step * step
    return p, q, d * weight[p, q]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.column(0):
            held = [_block(side["rows"].values) for side in row]
            (i, ni, a), (j, nj, b) = held[0], held[-1]
            p, q, d = _mutual(a, ni, b, nj, i, j)
            low, high = np.minimum(i[p], j[q]), np.maximum(i[p], j[q])
            # least distance, of equals the pair that comes first
            for at, own, mate in [(p, i, j[q])] if len(held) == 1 else [(p, i, j[q]), (q, j, i[p])]:
                order = np.lexsort((high, low, d, at))
                first = order[np.append(True, at[order][1:] != at[order][:-1])[: len(order)]]
                yield pa.RecordBatch.from_arrays([pa.array(own[at[first]]), pa.array(d[first]), pa.array(mate[first])], ["rep", "d", "mate"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges of the last groups, by a chain of nearest neighbours."""
    for batch in batches:
        for row in batch.column(0):
            rows = row.values
            rep, size, centre = _block(rows)
            node, height = rows.field("node").to_numpy().copy(), rows.field("height").to_numpy().copy()
            rep, centre = rep.copy(), centre.copy()
            following = (int(node.max()) >> ROUND) + 1
            alive, chain, out = np.ones(len(rep), bool), [], []
            while alive.sum() > 1:
                at = np.flatnonzero(alive)
                if not chain:
                    chain = [int(at[rep[at].argmin()])]
                x = chain[-1]
                others = at[at != x]
                best, mate = _least(_distances(centre[[x]], size[[x]], centre[others], size[others]), rep[[x]], rep[others])
                y = int(others[rep[others] == mate[0]][0])
                if len(chain) < 2 or chain[-2] != y:
                    chain.append(y)
                    continue
                chain = chain[:-2]
                x, y = (x, y) if rep[x] < rep[y] else (y, x)
                height[x] = max(float(np.sqrt(best[0])), height[x], height[y])
                out.append((following << ROUND | int(rep[x]), int(node[x]), int(node[y]), float(height[x]), int(size[x] + size[y])))
                centre[x] = (size[x] * centre[x] + size[y] * centre[y]) / (size[x] + size[y])
                size[x] += size[y]
                node[x], alive[y] = out[-1][0], False
                following += 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())], ["node", "a", "b", "height", "size"])


def ward_tree(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Merges (step, a, b, height, size) of Ward's linkage of points (idx, vector), in order of height.

    Leaves are numbered by idx from 0; the merge of step k makes node n + k. In a round, every group's nearest is found
    block against block, and all pairs that are each other's nearest merge; vectors never reach the driver. Data on which
    few pairs are so (distances that keep growing along a line) take many rounds.
    """
    ship(points.sparkSession)
    leaves = numbered(points.select("idx", F.col("vector").cast("array<double>").alias("vector")), [F.col("idx")])
    place = F.col("place").cast("long")
    live = checkpointed(leaves.select(place.alias("rep"), place.alias("node"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height"), "vector"))
    n = left = live.count()
    merges = live.sparkSession.createDataFrame([], _MERGE)
    k = 0
    while left > max(block, 1):
        k += 1
        near = _block_pairs(live.withColumnRenamed("rep", "idx"), block)
        near = near.select(F.transform("sides", lambda s: F.struct(s["b"].alias("b"), F.transform(s["rows"], lambda r: F.struct(r["idx"].alias("rep"), r["size"].alias("size"), r["vector"].alias("vector"))).alias("rows"))).alias("sides"))
        found = near.mapInArrow(_nearest, "rep long, d double, mate long")
        pair = F.struct("d", F.least("rep", "mate").alias("low"), F.greatest("rep", "mate").alias("high"))
        best = found.where("d < double('inf')").groupBy("rep").agg(F.min(pair).alias("e"))
        both = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.*")
        side = lambda name: F.struct("rep", "node", "size", "height", "vector").alias(name)
        x = both.join(live.select(F.col("rep").alias("low"), side("x")), "low").join(live.select(F.col("rep").alias("high"), side("y")), "high")
        size = (F.col("x.size") + F.col("y.size")).alias("size")
        centre = F.zip_with("x.vector", "y.vector", lambda p, q: (F.col("x.size") * p + F.col("y.size") * q) / (F.col("x.size") + F.col("y.size"))).alias("vector")
        height = F.greatest(F.sqrt("d"), "x.height", "y.height").alias("height")
        made = checkpointed(x.select("low", "high", (F.lit(k << ROUND) + F.col("low")).alias("node"), F.col("x.node").alias("a"), F.col("y.node").alias("b"), height, size, centre))
        merges = merges.unionByName(made.select("node", "a", "b", "height", "size"))
        gone = made.select(F.explode(F.array("low", "high")).alias("rep"))
        live = checkpointed(live.join(gone, "rep", "left_anti").unionByName(made.select(F.col("low").alias("rep"), "node", "size", "height", "vector")))
        left = live.count()
    if left > 1:
        merges = merges.unionByName(live.groupBy().agg(F.collect_list(F.struct("rep", "node", "size", "height", "vector"))).mapInArrow(_finish, _MERGE))
    placed = checkpointed(numbered(checkpointed(merges), [F.col("height"), F.col("node")]).withColumn("place", F.col("place").cast("long")))
    ids = placed.select("node", (F.col("place") + n).alias("id"))
    for c in ("a", "b"):
        placed = placed.join(ids.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("id", c)).drop("id")
    return placed.select(F.col("place").alias("step"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "height", "size")


def clades(merges: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """(cut, leaf, clade) for the tree cut into each number of clades: the n - cut lowest merges hold. Clades are
    numbered from 0 by their first leaf.

    Parents are found by jumping: each round a node's pointer goes twice as far. Nodes whose pointer has reached the top
    of its clade drop out.
    """
    n = merges.count() + 1
    spark = merges.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(k), max(0, n - int(k))) for k in cuts], "cut int, held long"))
    held = merges.join(asked, F.col("step") < F.col("held"))
    edges = held.select("cut", F.explode(F.array("a", "b")).alias("node"), (F.col("step") + n).alias("up"))
    tops = held.select("cut", (F.col("step") + n).alias("node")).join(edges.select("cut", "node"), ["cut", "node"], "left_anti")
    now = checkpointed(edges.join(tops.select("cut", F.col("node").alias("up"), F.lit(True).alias("top")), ["cut", "up"], "left").select("cut", "node", "up", F.coalesce("top", F.lit(False)).alias("top")))
    done = []
    while True:
        done.append(now.where("top and node < " + str(n)).select("cut", F.col("node").alias("leaf"), "up"))
        waiting = now.where("not top")
        if waiting.isEmpty():
            break
        further = now.select("cut", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        jumped = waiting.join(further, ["cut", "up"]).select("cut", "node", F.col("up2").alias("up"), F.col("top2").alias("top"))
        # what has arrived is looked up by those below, but jumps no more
        settled = now.where("top and node >= " + str(n))
        now = checkpointed(jumped.unionByName(settled))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    leaves = spark.range(n).select(F.col("id").alias("leaf")).join(asked.select("cut"))
    all_leaves = leaves.join(found, ["cut", "leaf"], "left").select("cut", "leaf", F.coalesce("up", "leaf").alias("top"))
    firsts = all_leaves.groupBy("cut", "top").agg(F.min("leaf").alias("first"))
    # one row per clade, at most the cut's number of them
    named = firsts.withColumn("clade", F.row_number().over(Window.partitionBy("cut").orderBy("first")) - 1)
    return all_leaves.join(named, ["cut", "top"]).select("cut", "leaf", "clade")


def average_linkage(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(idx, region) of points (idx, vector): groups merge while their mean distance is at most ``threshold``. A region
    is known by its least idx.

    A table holds the sum of distances between each two groups; a round merges groups that are each other's nearest and
    adds their rows up. For centres of regions: the table has the square of their number.
    """
    work = _block_pairs(points.select("idx", F.col("vector").cast("array<double>").alias("vector")), block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                held = []
                for side in row:
                    x = side["rows"].values
                    ids = x.field("idx").to_numpy()
                    held.append((ids, x.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
                (i, a), (j, b) = held[0], held[-1]
                one = np.ones(1)
                for k in range(len(i)):
                    d = np.sqrt(_distances(a[[k]], one, b, np.ones(len(j)))[0])
                    later = j > i[k] if len(held) == 1 else np.ones(len(j), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[k], j[later])), pa.array(np.maximum(i[k], j[later])), pa.array(d[later])], ["u", "v", "sum"])

    sums = checkpointed(work.mapInArrow(compare, "u long, v long, sum double"))
    member = checkpointed(points.select("idx", F.col("idx").alias("region")))
    sizes = points.select(F.col("idx").alias("g"), F.lit(1).cast("long").alias("n"))
    while True:
        mean = sums.join(sizes.select(F.col("g").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("g").alias("v"), F.col("n").alias("nv")), "v")
        edge = F.struct((F.col("sum") / F.col("nu") / F.col("nv")).alias("d"), "u", "v")
        best = mean.select(edge.alias("e")).select("e", F.explode(F.array("e.u", "e.v")).alias("g")).groupBy("g").agg(F.min("e").alias("e"))
        joined = checkpointed(best.groupBy("e").agg(F.count("*").alias("k")).where(f"k = 2 and e.d <= {float(threshold)!r}").select("e.u", "e.v"))
        if joined.isEmpty():
            return member
        into = joined.select(F.col("v").alias("from"), F.col("u").alias("to"))
        for side in ("u", "v"):
            sums = sums.join(into.withColumnRenamed("from", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        sums = checkpointed(sums.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("sum").alias("sum")))
        member = checkpointed(member.join(into, F.col("region") == F.col("from"), "left").select("idx", F.coalesce("to", "region").alias("region")))
        sizes = checkpointed(member.groupBy(F.col("region").alias("g")).agg(F.count("*").alias("n")))


def unique_names(wishes: DataFrame) -> DataFrame:
    """(region, name) for regions (region, area, names as an array of wishes): the largest has its first wish, the next
    the first that is left, and so on; null if none is left. Ties of area go to the smallest region.

    In rounds of proposals: every region without a name asks for its next wish, and a name stays with, or goes over to,
    the largest that has asked for it. As all names prefer in one order, that ends where taking turns would.
    """
    asks = checkpointed(wishes.select("region", "area", F.posexplode("names").alias("at", "name")).groupBy("region", "area", "name").agg(F.min("at").alias("at")))
    order = F.struct((-F.col("area")).alias("area"), "region", "at")
    refused = None
    while True:
        open_asks = asks if refused is None else asks.join(refused, ["region", "name"], "left_anti")
        proposal = open_asks.groupBy("region").agg(F.min_by(F.struct("area", "at", "name"), "at").alias("p")).select("region", "p.*")
        holder = proposal.groupBy("name").agg(F.min(order).alias("h")).select("name", F.col("h.region").alias("holder"))
        lost = checkpointed(proposal.join(holder, "name").where("region <> holder").select("region", "name"))
        if lost.isEmpty():
            return wishes.select("region").join(proposal.select("region", "name"), "region", "left")
        refused = checkpointed(lost if refused is None else refused.unionByName(lost))
