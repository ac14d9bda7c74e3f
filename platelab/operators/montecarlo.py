"""Monte Carlo uncertainty with counter-based random numbers: any row can be drawn anywhere, and again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = 1 << 31
#: Draws for each recipe (the reference's number).
N = 10_000
PERCENTILES = {"p2_5": 0.025, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p97_5": 0.975}


def uniform(k: Column, j: Column, stream: int) -> Column:
    """A number between 0 and 1 from two counters and a stream."""
    x = F.pmod(F.pmod(k, F.lit(M)) * 2654435761 + j * 40503 + stream * 97, F.lit(M))
    for c in (739982445, 695872825, 1103515245):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * c, F.lit(M))
    return (x.bitwiseXOR(F.shiftright(x, 16)) + 0.5) / M


def triangular(u: Column, least: Column, mode: Column, most: Column) -> Column:
    """Inverse distribution; constant where both ends agree."""
    width = F.nullif(most - least, F.lit(0.0))
    cut = (mode - least) / width
    low = least + F.sqrt(u * width * (mode - least))
    high = most - F.sqrt((1 - u) * width * (most - mode))
    return F.when(most == least, mode).when(u < cut, low).otherwise(high)


def normal(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def draws(rows: DataFrame, n: int, seed: int = 0, mass_error: float = 0.15) -> DataFrame:
    """``rows`` (recipe_id, position, grams, least, mode, most) times n draws of each ingredient's impact.

    Mass is normal around its value and is not cut off; the factor is triangular.
    """
    x = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = (F.col("recipe_id") + seed) * n + F.col("draw")
    factor = triangular(uniform(k, F.col("position"), 1), F.col("least"), F.col("mode"), F.col("most"))
    mass = F.col("grams") * (1 + mass_error * normal(uniform(k, F.col("position"), 2), uniform(k, F.col("position"), 3)))
    return x.select("recipe_id", "position", "ingredient", "draw", (mass * factor).alias("impact"))


def summarised(drawn: DataFrame) -> DataFrame:
    """Mean, deviation and percentiles of each recipe's total over the draws."""
    totals = drawn.groupBy("recipe_id", "draw").agg(F.sum("impact").alias("total"))
    shares = F.percentile("total", F.array(*[F.lit(p) for p in PERCENTILES.values()]))
    out = totals.groupBy("recipe_id").agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), shares.alias("p"))
    return out.select("recipe_id", "mean", "sd", *[F.element_at("p", i + 1).alias(n) for i, n in enumerate(PERCENTILES)])


def variance_drivers(drawn: DataFrame, top: int = 5) -> DataFrame:
    """The ingredients that contribute most to the variance of a recipe's total; of one name, the last place counts."""
    each = drawn.groupBy("recipe_id", "ingredient", "position").agg(F.var_samp("impact").alias("variance"))
    last = each.groupBy("recipe_id", "ingredient").agg(F.max_by("variance", "position").alias("variance"))
    total = drawn.groupBy("recipe_id", "draw").agg(F.sum("impact").alias("t")).groupBy("recipe_id").agg(F.var_samp("t").alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("variance") / F.col("whole")).otherwise(0.0)
    w = Window.partitionBy("recipe_id").orderBy(F.desc("share"), "ingredient")
    return last.join(total, "recipe_id").withColumn("share", share).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("recipe_id", "rank", "ingredient", "share")


#: Recipes whose counters lie so near each other (in recipes' lengths) that one task draws for all of them.
NEAR = 16
#: Stretches of draws that a task keeps, one for each place in a recipe and shape of a factor.
HELD = 256
Shape = tuple[float, float, float]


#: Cosine and sine of so many parts of a turn, from which the others follow.
PARTS = 1 << 14
_ANGLES = 2 * np.pi * ((np.arange(PARTS) + 0.5) / PARTS)
_COSINE, _SINE = np.cos(_ANGLES), np.sin(_ANGLES)


def _counters(k: np.ndarray, j: int, stream: int) -> np.ndarray:
    """``uniform`` of counters modulo 2^32, which leaves its lowest 31 bits as they are, before it becomes a fraction."""
    x = k * np.uint32(2654435761)
    x += np.uint32((j * 40503 + stream * 97) % (1 << 32))
    x &= np.uint32(M - 1)
    spare = np.empty_like(x)
    for c in (739982445, 695872825, 1103515245):
        x ^= np.right_shift(x, np.uint32(15), out=spare)
        x *= np.uint32(c)
        x &= np.uint32(M - 1)
    x ^= np.right_shift(x, np.uint32(16), out=spare)
    return x


def _uniforms(k: np.ndarray, j: int, stream: int) -> np.ndarray:
    u = _counters(k, j, stream).astype(np.float64)
    u += 0.5
    u *= 1 / M
    return u


def _cosines(k: np.ndarray, j: int, stream: int) -> np.ndarray:
    """Cosine of a turn times ``uniform``: by the angles' sum, of a part's middle and a rest too small for more than
    three terms."""
    x = _counters(k, j, stream)
    at = x >> np.uint32(31 - PARTS.bit_length() + 1)
    x &= np.uint32(M // PARTS - 1)
    rest = x.astype(np.float64)
    rest += 0.5 - M // PARTS / 2
    rest *= 2 * np.pi / M
    square = rest * rest
    out = square * -0.5
    out += 1
    out *= _COSINE.take(at)
    square *= -1 / 6
    square += 1
    square *= rest
    square *= _SINE.take(at)
    out -= square
    return out


def _triangular(u: np.ndarray, least: float, mode: float, most: float) -> np.ndarray:
    """``triangular``: up to the mode by one root and from there by the other, each of which stays at the mode beyond."""
    width = most - least
    out = u * (width * (mode - least))
    np.sqrt(out, out=out)
    out += least
    np.minimum(out, mode, out=out)
    high = 1 - u
    high *= width * (most - mode)
    np.sqrt(high, out=high)
    np.subtract(most, high, out=high)
    np.maximum(high, mode, out=high)
    high -= mode
    out += high
    return out


def _shape(least: float, mode: float, most: float) -> tuple[float, Shape]:
    """A factor's size, and the factor in parts of it: many factors have few shapes."""
    size = max(abs(least), abs(mode), abs(most))
    if not 0 < size < np.inf:
        size = 1.0
    return size, (least / size, mode / size, most / size)


class _Draws:
    """Draws of one gram of a factor of size one, by counter, place in the recipe and shape of the factor.

    A draw depends on nothing else, and recipes whose counters overlap (they count modulo 2^31) draw the same there. Asked
    for counters in rising order, it makes each draw once and forgets those below.
    """

    def __init__(self, n: int, mass_error: float):
        self.n, self.mass_error, self.low = n, mass_error, 0
        self.held: dict[tuple, tuple[int, list[np.ndarray]]] = {}

    def _kept(self, key: tuple, at: int, n: int, make) -> list[np.ndarray]:
        start, has = self.held.pop(key, (at, []))
        end = start + len(has[0]) if has else at
        if not start <= at <= end:
            start, end, has = at, at, []
        if at + n > end:
            # single draws ahead of their time cost more than half a recipe's at once
            new = make(end, at + n - end if end == at else max(at + n - end, self.n // 2))
            cut = max(0, min(self.low, end) - start)
            start, has = start + cut, [np.concatenate([a[cut:], b]) for a, b in zip(has, new, strict=True)] if has else new
        while len(self.held) >= HELD:
            del self.held[next(iter(self.held))]
        self.held[key] = start, has
        return [a[at - start : at - start + n] for a in has]

    def _made(self, j: int, at: int, n: int) -> list[np.ndarray]:
        """What a factor's number between 0 and 1 is, and by what the mass is multiplied."""
        k = (np.arange(n, dtype=np.int64) + at).astype(np.uint32)
        mass = _uniforms(k, j, 2)
        np.log(mass, out=mass)
        mass *= -2
        np.sqrt(mass, out=mass)
        mass *= _cosines(k, j, 3)
        mass *= self.mass_error
        mass += 1
        return [_uniforms(k, j, 1), mass]

    def _units(self, j: int, shape: Shape, at: int, n: int) -> list[np.ndarray]:
        u, mass = self._kept((j,), at, n, lambda *x: self._made(j, *x))
        return [mass * (shape[1] if shape[0] == shape[2] else _triangular(u, *shape))]

    def units(self, j: int, shape: Shape, at: int) -> np.ndarray:
        self.low = at
        return self._kept((j, shape), at, self.n, lambda *x: self._units(j, shape, *x))[0]


_OUT = "recipe_id long, mean double, sd double, " + ", ".join(f"{p} double" for p in PERCENTILES) + ", drivers array<struct<ingredient: string, share: double>>"
_OUT_ARROW = pa.schema([("recipe_id", pa.int64()), *[(c, pa.float64()) for c in ("mean", "sd", *PERCENTILES)], ("drivers", pa.list_(pa.struct([("ingredient", pa.string()), ("share", pa.float64())])))])


def _percentiles(totals: np.ndarray) -> list[float]:
    """As ``percentile`` has them; ``totals`` is sorted."""
    totals.sort()
    if totals[-1] != totals[-1]:
        return [float("nan")] * len(PERCENTILES)
    out, n = [], len(totals) - 1
    for p in PERCENTILES.values():
        at = p * n
        low = int(at)
        a, b, t = totals.item(low), totals.item(min(low + 1, n)), at - low
        out.append(a if a == b else a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return out


def _spread(x: np.ndarray) -> tuple[float, float]:
    """Mean, and the sum of squares around it."""
    mean = float(np.add.reduce(x)) / len(x)
    d = x - mean
    return mean, float(d @ d)


def _recipe(draws: _Draws, recipe_id: int | None, at: int | None, rows: list[dict], top: int, percentiles: bool) -> dict:
    names, n = ("position", "grams", "least", "mode", "most"), draws.n
    known = [r for r in rows if all(r[c] is not None for c in names)]
    if not known or recipe_id is None:
        return {"recipe_id": recipe_id}
    lines, weights = [], {}
    for r in sorted(known, key=lambda r: tuple(r[c] for c in names)):
        size, shape = _shape(r["least"], r["mode"], r["most"])
        lines.append((r, (r["position"], shape), r["grams"] * size))
        weights[lines[-1][1]] = weights.get(lines[-1][1], 0.0) + lines[-1][2]
    units = {key: draws.units(*key, at) for key in weights}
    totals = np.zeros(n)
    for key, weight in weights.items():
        totals += units[key] * weight
    mean, squares = _spread(totals)
    whole = squares / (n - 1) if n > 1 else None
    out = {"recipe_id": recipe_id, "mean": mean, "sd": None if whole is None else whole**0.5}
    if percentiles:
        out |= dict(zip(PERCENTILES, _percentiles(totals), strict=True))
    if top:
        spreads = {key: _spread(x) for key, x in units.items()}
        of: dict[tuple, list[tuple[float, float]]] = {}
        for r, key, weight in lines:
            of.setdefault((r["position"], r["ingredient"]), []).append((weight * spreads[key][0], weight * weight * spreads[key][1]))
        last = {}
        for (_, name), parts in sorted(of.items(), key=lambda e: e[0][0]):
            middle = sum(m for m, _ in parts) / len(parts)
            around = sum(s + n * (m - middle) ** 2 for m, s in parts)
            last[name] = around / (n * len(parts) - 1) / whole if whole else 0.0
        out["drivers"] = [{"ingredient": name, "share": share} for name, share in sorted(last.items(), key=lambda e: (-e[1], e[0] or ""))[:top]]
    return out


def simulated(rows: DataFrame, n: int = N, seed: int = 0, mass_error: float = 0.15, top: int = 5, percentiles: bool = True) -> DataFrame:
    """One row for each recipe of ``rows``: what ``summarised`` finds, and as ``drivers`` what ``variance_drivers`` finds.

    A recipe's draws are made and used up in one place, so no draw is ever a row or shuffled. Recipes whose counters are
    near each other modulo 2^31 come one after the other, and what they have in common is drawn once. Without
    ``percentiles``, or with ``top`` 0, these are left out (null).
    """
    at = F.pmod(F.pmod(F.col("recipe_id") + seed, F.lit(M)) * n, F.lit(M)).cast("long")
    lines = F.struct("position", "ingredient", *[F.col(c).cast("double").alias(c) for c in ("grams", "least", "mode", "most")])
    placed = rows.select("recipe_id", at.alias("at"), F.floor(at / (NEAR * n)).cast("long").alias("near"), lines.alias("line")).repartition("near")
    recipes = placed.groupBy("near", "at", "recipe_id").agg(F.collect_list("line").alias("rows")).sortWithinPartitions("at", "recipe_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _Draws(n, mass_error)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([_recipe(draws, r["recipe_id"], r["at"], r["rows"], top, percentiles) for r in part], _OUT_ARROW)

    return recipes.select("recipe_id", "at", "rows").mapInArrow(run, _OUT)
