"""Best cases within a neighbourhood of similar dishes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from platelab.session import checkpointed, ship

from .ordering import weighted_quantiles


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the inner product of unit vectors, not below 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), 1 - dot)


#: Dishes in a block.
BLOCK = 1024


def as_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with vector as it goes to the tasks: single precision stays, as it takes half the room, all else is double."""
    kind = rows.schema["vector"].dataType
    return rows if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else rows.withColumn("vector", F.col("vector").cast("array<double>"))


def matrix(rows: pa.StructArray) -> np.ndarray:
    """Vectors of a block's rows in double precision."""
    return rows.field("vector").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(rows), -1)


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """``sides``: one or two blocks of whole rows (with idx), for each pair of blocks and each block by itself.

    Blocks are packed once. Of two blocks one goes to where the other is, now the former and now the latter, so that each
    block stays in one place and meets half of the others there, one after another; no task collects pairs of blocks.
    """
    ship(rows.sparkSession)
    parts = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int")
    packed = checkpointed(rows.groupBy(own.alias("b")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")))
    goes = lambda o: (o == F.col("b")) | ((F.col("b") < o) == ((F.col("b") + o) % 2 == 0))
    sent = packed.select(F.struct("b", "rows").alias("one"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), goes)).alias("o"))
    held = packed.select(F.col("b").alias("o"), F.struct("b", "rows").alias("other"))
    pairs = sent.join(held.hint("shuffle_hash"), "o")
    return pairs.select(F.when(F.col("one.b") == F.col("o"), F.array("one")).otherwise(F.array("one", "other")).alias("sides"))


#: Blocks of dishes that are packed as one where they are compared with others.
FACED = 8
#: Bytes of a packed block, and of all packed blocks that a task holds.
FACED_BYTES, HELD_BYTES = 4 << 20, 64 << 20


def _facing(rows: DataFrame, block: int) -> DataFrame:
    """(one, other): whole rows (with idx) of a few dishes, and of a larger block that they are compared with, for all.

    Nothing is shuffled but the dishes themselves, once: a task gets some of them and reads the blocks they face where
    these are packed, in as many parts as its memory asks for. Each dish meets a part in one task, so what is found for it
    comes in a row for each block and is merged before it leaves the task.
    """
    spark = rows.sparkSession
    ship(spark)
    count, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(1, size or 0) * (4 if rows.schema["vector"].dataType.jsonValue()["elementType"] == "float" else 8)
    parts = max(1, -(-count // (block * max(1, min(FACED, FACED_BYTES // (block * width))))))
    cores = spark.sparkContext.defaultParallelism
    few = min(block, max(64, -(-count // (2 * cores))))
    own = F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int")
    packed = checkpointed(rows.groupBy(own.alias("b")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))).select("rows")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / few).cast("int")), lambda k: F.slice("rows", k * few + 1, few))
    one = packed.select(F.explode(cut).alias("one")).repartition(max(1, min(-(-count // few), max(64, 2 * cores))))
    return one.hint("shuffle_replicate_nl").crossJoin(packed.select(F.col("rows").alias("other")).coalesce(max(1, -(-count * width // HELD_BYTES))))


#: Pairs of dishes whose distances a task has at once.
STRIP = 1 << 18


def _strips(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some dishes at a time: which, and of their pairs at most ``radius`` apart the row among these, the column and the
    distance, in order. ``other`` is in order; a dish is at distance 0 of itself."""
    step = max(1, STRIP // max(1, len(other)))
    first, last = np.searchsorted(other, one, "left"), np.searchsorted(other, one, "right")
    for top in range(0, len(one), step):
        d = a[top : top + step] @ b.T
        np.subtract(1, d, out=d)
        np.maximum(0.0, d, out=d)
        for r in np.flatnonzero(first[top : top + step] < last[top : top + step]):
            d[r, first[top + r] : last[top + r]] = 0.0
        hit = np.flatnonzero(d <= radius)
        r, c = np.divmod(hit, len(other))
        yield slice(top, top + len(d)), r, c, d.ravel()[hit]


def pairs_within(dishes: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """(i, j, distance) of all dishes (idx, vector) at most ``radius`` apart; a dish is at distance 0 of itself.

    Dishes are dealt into blocks of bounded size, and each pair of blocks is one row of work: a block is sent to as
    many tasks as there are blocks, and a task holds two of them.
    """
    work = _block_pairs(as_vectors(dishes.select("idx", "vector")), block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                held = []
                for side in row:
                    rows = side["rows"].values
                    ids = rows.field("idx").to_numpy()
                    held.append((ids, matrix(rows)))
                combos = [(held[0], held[0])] if len(held) == 1 else [(held[0], held[1])]
                for (i, a), (j, b) in combos:
                    for top in range(0, len(i), 512):
                        d = np.maximum(0.0, 1 - a[top : top + 512] @ b.T)
                        d[i[top : top + 512, None] == j[None]] = 0.0
                        x, y = np.nonzero(d <= radius)
                        yield pa.RecordBatch.from_arrays([pa.array(i[top + x]), pa.array(j[y]), pa.array(d[x, y])], ["i", "j", "distance"])
                        if len(held) == 2:
                            yield pa.RecordBatch.from_arrays([pa.array(j[y]), pa.array(i[top + x]), pa.array(d[x, y])], ["i", "j", "distance"])

    return work.mapInArrow(compare, "i long, j long, distance double")


def improvements(pairs: DataFrame, metrics: DataFrame, lower: Sequence[str], higher: Sequence[str], radii: Sequence[float], allowed: Column | None = None) -> DataFrame:
    """Per dish and radius: neighbours, and by metric how much better the best neighbour is.

    ``metrics`` has idx and the metrics. Where less is better the gain is a share of the dish's own value (null unless
    that is positive); where more is better it is a difference.
    """
    names = [*lower, *higher]
    own = metrics.select(F.col("idx").alias("i"), *[F.col(n).alias(f"own_{n}") for n in names])
    near = metrics.select(F.col("idx").alias("j"), *names)
    x = pairs.join(own, "i").join(near, "j")
    x = x if allowed is None else x.where(allowed | (F.col("i") == F.col("j")))
    within = lambda r, c: F.when(F.col("distance") <= r, c)
    cols = []
    for k, r in enumerate(radii):
        cols.append(F.count_if(F.col("distance") <= r).alias(f"n_{k}"))
        cols += [F.min(within(r, F.col(n))).alias(f"b_{n}_{k}") for n in lower] + [F.max(within(r, F.col(n))).alias(f"b_{n}_{k}") for n in higher]
    best = x.groupBy("i", *[f"own_{n}" for n in names]).agg(*cols)
    gain = lambda n, k: (F.when(F.col(f"own_{n}") > 0, (F.col(f"own_{n}") - F.col(f"b_{n}_{k}")) / F.col(f"own_{n}")) if n in lower else F.col(f"b_{n}_{k}") - F.col(f"own_{n}")).alias(n)
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"n_{k}").alias("neighbors"), *[gain(n, k) for n in names]) for k, r in enumerate(radii)]))
    return best.select(F.col("i").alias("idx"), rows.alias("r")).select("idx", "r.*")


def best_gains(dishes: DataFrame, metrics: DataFrame, lower: Sequence[str], higher: Sequence[str], radii: Sequence[float], block: int = BLOCK) -> DataFrame:
    """What ``improvements`` finds among all dishes (idx, vector) that have metrics, without putting out any pair.

    A task compares some dishes with a block and returns, for each dish and radius that is the first to reach any of
    these, how many it reaches and the best of each metric among them. Radii are summed up once these few rows are merged.
    """
    names = [*lower, *higher]
    rows = as_vectors(dishes.select("idx", "vector")).join(metrics.select("idx", F.array(*[F.col(n).cast("double") for n in names]).alias("m")), "idx")
    work = _facing(rows, block)
    steps = [float(r) for r in radii]
    sign = np.array([1.0] * len(lower) + [-1.0] * len(higher))
    out = ["idx", "step", "n", *[f"b{c}" for c in range(len(names))]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                i, a, j, b = one.values.field("idx").to_numpy(), matrix(one.values), other.values.field("idx").to_numpy(), matrix(other.values)
                v = other.values.field("m").flatten().to_numpy(zero_copy_only=False).reshape(len(j), len(names)) * sign
                order = np.argsort(j, kind="stable")
                j, b, v = j[order], b[order], v[order].T.copy()
                found = []
                for strip, r, c, d in _strips(i, a, j, b, steps[-1]):
                    cell = r * len(steps)
                    for s in steps[:-1]:
                        cell += d > s
                    n = np.bincount(cell)
                    best = np.full((len(names), len(n)), np.nan)
                    for k in range(len(names)):
                        np.fmin.at(best[k], cell, v[k][c])
                    seen = np.flatnonzero(n)
                    found.append((i[strip][seen // len(steps)], (seen % len(steps)).astype(np.int32), n[seen], *(best * sign[:, None])[:, seen]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), from_pandas=True) for x in zip(*found, strict=True)], out)

    found = work.mapInArrow(compare, "idx long, step int, n long, " + ", ".join(f"{b} double" for b in out[3:]))
    merged = found.groupBy("idx", "step").agg(F.sum("n").alias("n"), *[(F.min if c < len(lower) else F.max)(b).alias(b) for c, b in enumerate(out[3:])])
    best = merged.groupBy("idx").agg(F.collect_list(F.struct(*out[1:])).alias("s"))
    own = metrics.select("idx", *[F.col(n).alias(f"own_{n}") for n in names])
    gain = lambda c, n: (F.when(F.col(f"own_{n}") > 0, (F.col(f"own_{n}") - F.col(f"b{c}")) / F.col(f"own_{n}")) if n in lower else F.col(f"b{c}") - F.col(f"own_{n}")).alias(n)
    within = lambda k: F.filter("s", lambda x: x["step"] <= k)
    least = [(F.array_min if c < len(lower) else F.array_max)(f"x.s.{b}").alias(b) for c, b in enumerate(out[3:])]
    each = best.join(own, "idx").select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(steps) - 1)), lambda k: F.struct(k.alias("step"), within(k).alias("s")))).alias("x"))
    neighbours = F.aggregate("x.s", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("neighbors")
    radius = F.element_at(F.array(*map(F.lit, steps)), F.col("x.step") + 1).alias("radius")
    return each.select("idx", radius, neighbours, *least, *[f"own_{n}" for n in names]).select("idx", "radius", "neighbors", *[gain(c, n) for c, n in enumerate(names)])


def curve(gains: DataFrame, names: Sequence[str]) -> DataFrame:
    """By radius: mean and median neighbours, and mean and quartiles of each gain."""
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    of = gains.groupBy("radius").agg(F.avg("neighbors").alias("mean_neighbors"), F.percentile("neighbors", F.lit(0.5)).alias("median_neighbors"), *[c for n in names for c in (F.avg(n).alias(f"{n}_mean"), F.percentile(n, F.array(*map(F.lit, shares.values()))).alias(f"{n}_at"))])
    return of.select("radius", "mean_neighbors", "median_neighbors", *[c for n in names for c in (F.col(f"{n}_mean"), *[F.get(f"{n}_at", F.lit(k)).alias(f"{n}_{label}") for k, label in enumerate(shares)])])


def macro_shares(protein: Column, fat: Column, carb: Column) -> Column:
    """Percent of energy from each macronutrient."""
    total = 4 * protein + 9 * fat + 4 * carb
    share = lambda v: F.try_divide(100 * v, total)
    return F.struct(share(4 * protein).alias("protein"), share(9 * fat).alias("fat"), share(4 * carb).alias("carb"))


def total_variation(a: Column, b: Column) -> Column:
    return (F.abs(a["protein"] - b["protein"]) + F.abs(a["fat"] - b["fat"]) + F.abs(a["carb"] - b["carb"])) / 2


Side = dict[str, np.ndarray]
#: Rows and columns of the pairs that are near, in order of both.
Near = tuple[np.ndarray, np.ndarray]


def _sides(blocks: Sequence[pa.StructArray], texts: Sequence[str]) -> list[Side]:
    """Blocks as arrays in order of idx; nulls are NaN, texts are numbers that agree between the blocks."""
    out: list[Side] = []
    for x in blocks:
        ids = x.field("idx").to_numpy()
        held = {f.name: x.field(f.name).to_numpy(zero_copy_only=False).astype(float) for f in x.type if f.name not in ("idx", "vector", *texts)}
        out.append(held | {"idx": ids, "vector": matrix(x)})
    for name in texts:
        codes = pa.concat_arrays([x.field(name) for x in blocks]).dictionary_encode().indices.fill_null(-1).to_numpy()
        for held, part in zip(out, np.split(codes, np.cumsum([len(x) for x in blocks])[:-1]), strict=True):
            held[name] = part
    orders = [np.argsort(held["idx"], kind="stable") for held in out]
    return [{k: v[order] for k, v in held.items()} for held, order in zip(out, orders, strict=True)]


def nearest_best(rows: DataFrame, radius: float, visit: Callable[[Side, Side, Near], dict[str, np.ndarray]], schema: str, texts: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """What ``visit`` finds for each dish among those at most ``radius`` apart, block by block; no pair is put out.

    ``rows`` has idx, vector, numbers and ``texts``. ``visit`` gets some dishes, a block of dishes, and which of these are
    near which; it returns columns of ``schema``, a few rows a dish, which the caller merges over the blocks.
    """
    work = _facing(as_vectors(rows), block)
    names = [part.split()[0] for part in schema.split(",")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1), strict=True):
                one, other = _sides([x.values for x in row], texts)
                found = [visit({k: v[strip] for k, v in one.items()}, other, (r, c)) for strip, r, c, _ in _strips(one["idx"], one["vector"], other["idx"], other["vector"], radius)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in found]), from_pandas=True) for n in names], names)

    return work.mapInArrow(compare, schema)


def _first_best(value: np.ndarray, near: Near, own: Side, other: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value (of each pair; NaN never is) of each row, the least idx that has it, and its column; inf for none."""
    r, c = near
    held = np.where(np.isnan(value), np.inf, value)
    best, at = np.full(len(own["idx"]), np.inf), np.zeros(len(own["idx"]), np.int64)
    if len(r):
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        best[r[heads]] = np.minimum.reduceat(held, heads)
        first = np.flatnonzero(held == best[r])[::-1]
        at[r[first]] = c[first]
    return best, other["idx"][at], at


def tolerance_sweep(vectors: DataFrame, dishes: DataFrame, metric: str, tolerances: Sequence[float], radius: float, block: int = BLOCK) -> DataFrame:
    """Mean gain by how far the macronutrients of a neighbour may differ; ``dishes`` has idx, shares and the metric."""
    parts = ("protein", "fat", "carb")
    rows = vectors.select("idx", "vector").join(dishes.select("idx", F.col(metric).cast("double").alias("m"), *[F.col("shares")[p].alias(p) for p in parts]), "idx")
    steps = [float(t) for t in tolerances]

    def visit(own: Side, other: Side, near: Near) -> dict[str, np.ndarray]:
        r, c = near
        far = sum(np.abs(own[p][r] - other[p][c]) for p in parts) / 2
        far[own["idx"][r] == other["idx"][c]] = 0.0
        best = [_first_best(np.where(far <= t, other["m"][c], np.inf), near, own, other)[0] for t in steps]
        n = len(own["idx"])
        return {"idx": np.tile(own["idx"], len(steps)), "step": np.repeat(np.arange(len(steps), dtype=np.int32), n), "b": np.concatenate(best)}

    found = nearest_best(rows, radius, visit, "idx long, step int, b double", (), block).where("b < double('inf')")
    best = found.groupBy("idx", "step").agg(F.min("b").alias("b")).join(dishes.select("idx", F.col(metric).alias("own")), "idx")
    gain = F.when(F.col("own") > 0, (F.col("own") - F.col("b")) / F.col("own"))
    tolerance = F.element_at(F.array(*map(F.lit, steps)), F.col("step") + 1)
    return best.groupBy(tolerance.alias("tolerance")).agg(F.avg(gain).alias("mean_gain"))


def best_pick(vectors: DataFrame, metrics: DataFrame, metric: str, radius: float, lower: bool = True, block: int = BLOCK) -> DataFrame:
    """The best neighbour of each dish, itself included; ties go to the first."""
    rows = vectors.select("idx", "vector").join(metrics.select("idx", F.col(metric).cast("double").alias("m")), "idx", "left")
    sign = 1.0 if lower else -1.0

    def visit(own: Side, other: Side, near: Near) -> dict[str, np.ndarray]:
        best, pick, _ = _first_best(sign * other["m"][near[1]], near, own, other)
        return {"idx": own["idx"], "m": best, "pick": pick}

    found = nearest_best(rows, radius, visit, "idx long, m double, pick long", (), block).where("m < double('inf')")
    return found.groupBy("idx").agg(F.min_by("pick", F.struct("m", "pick")).alias("pick"))


def swap_search(vectors: DataFrame, dishes: DataFrame, radius: float = 0.2, block: int = BLOCK) -> DataFrame:
    """For each dish (idx, cuisine, ghg, health) the swap that gains most: emission cut by more than a tenth, no less
    health, of the same cuisine if there is one. Dishes without a finite value do not come into question."""
    rows = vectors.select("idx", "vector").join(dishes.select("idx", "cuisine", F.col("ghg").cast("double").alias("ghg"), F.col("health").cast("double").alias("health")), "idx")

    def visit(own: Side, other: Side, near: Near) -> dict[str, np.ndarray]:
        r, c = near
        g, h, ghg, health = own["ghg"][r], own["health"][r], other["ghg"][c], other["health"][c]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (g - ghg) / g + 2 * np.maximum(0.0, health - h)
            fits = (own["idx"][r] != other["idx"][c]) & (ghg < 0.9 * g) & (health >= h) & (g > 0) & np.isfinite(health)
            cost = -np.floor(score * 1e9 + 0.5) / 1e9
        same = own["cuisine"][r] == other["cuisine"][c]
        first, second = [_first_best(np.where(fits & which, cost, np.inf), near, own, other) for which in (same, ~same)]
        n = len(own["idx"])
        return {"idx": np.tile(own["idx"], 2), "other": np.repeat(np.arange(2, dtype=np.int32), n), "cost": np.concatenate([first[0], second[0]]), "swap": np.concatenate([first[1], second[1]])}

    found = nearest_best(rows, radius, visit, "idx long, other int, cost double, swap long", ("cuisine",), block).where("cost < double('inf')")
    return found.groupBy("idx").agg(F.min_by("swap", F.struct("other", "cost", "swap")).alias("swap"))


def co_benefits(vectors: DataFrame, dishes: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """How often the greenest neighbour is healthier too, and the healthiest greener, and both better at once."""
    rows = vectors.select("idx", "vector").join(dishes.select("idx", F.col("ghg").cast("double").alias("ghg"), F.col("health").cast("double").alias("health")), "idx")

    def visit(own: Side, other: Side, near: Near) -> dict[str, np.ndarray]:
        r, c = near
        ghg, g, at_g = _first_best(other["ghg"][c], near, own, other)
        health, h, at_h = _first_best(-other["health"][c], near, own, other)
        win = np.bincount(r[(other["ghg"][c] < own["ghg"][r]) & (other["health"][c] > own["health"][r])], minlength=len(own["idx"])) > 0
        return {"idx": own["idx"], "ghg": ghg, "g": g, "g_health": other["health"][at_g], "health": -health, "h": h, "h_ghg": other["ghg"][at_h], "win": win}

    found = nearest_best(rows, radius, visit, "idx long, ghg double, g long, g_health double, health double, h long, h_ghg double, win boolean", (), block)
    green, healthy = F.col("ghg") < float("inf"), F.col("health") > -float("inf")
    best = found.groupBy("idx").agg(
        F.min_by("g_health", F.when(green, F.struct("ghg", "g"))).alias("g_health"), F.min_by("h_ghg", F.when(healthy, F.struct((-F.col("health")).alias("s"), "h"))).alias("h_ghg"),
        F.bool_or(green).alias("has_g"), F.bool_or(healthy).alias("has_h"), F.bool_or("win").alias("win"),
    )
    x = best.join(dishes.select("idx", "ghg", "health"), "idx")
    rate = lambda c: F.avg(F.when(F.col("has_g") & F.col("has_h"), F.when(c, 1.0).otherwise(0.0)))
    win = F.avg(F.when(F.col("win"), 1.0).otherwise(0.0)).alias("win_win")
    return x.agg(rate(F.col("g_health") > F.col("health")).alias("greenest_healthier"), rate(F.col("h_ghg") < F.col("ghg")).alias("healthiest_greener"), win)


def weighted_curve(gains: DataFrame, name: str, weight: str) -> DataFrame:
    """Weighted mean and quartiles of a gain by radius."""
    means = gains.where(F.col(name).isNotNull()).groupBy("radius").agg((F.sum(F.col(weight) * F.col(name)) / F.sum(weight)).alias("mean"))
    return means.join(weighted_quantiles(gains, ["radius"], name, weight, (0.25, 0.5, 0.75)), "radius")

