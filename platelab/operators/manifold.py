"""Dish vectors, classes, trees and what the map shows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelab.functions.text import contains_any
from platelab.session import checkpointed, ship

from .cleaning import numbered
from .ordering import ranked


def usable_dishes(recipes: DataFrame, least: int = 2) -> DataFrame:
    """Recipes without error, with mass and seen at least so often (recipe_id, error, total_count, mass)."""
    return recipes.where((F.coalesce("error", F.lit("")) == "") & (F.col("mass") > 0) & (F.col("total_count") >= least))


def vocabulary(rows: DataFrame, name: str) -> DataFrame:
    """Distinct values in order with their place from 0."""
    return numbered(rows.select(F.col(name).alias("value")).where("value is not null").distinct(), [F.col("value")])


#: Vectors of no more numbers than this in all are sent to the tasks, which then get rows of dishes without vectors.
BROADCAST_NUMBERS = 1 << 22
#: Vectors of no more bytes than this are read by each task where they are packed, in parts of ``PART_BYTES``, for
#: ``LINES`` rows of dishes at a time.
READ_BYTES, PART_BYTES, LINES = 1 << 28, 16 << 20, 1 << 17


def dish_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of ingredients' vectors by weight, at unit length: rows (dish, ingredient, weight), vectors (ingredient,
    vector). Where vectors are of one size and fit a task, only rows of dishes are shuffled; else vectors are joined to
    them, and sums run per dimension, so that they combine before the shuffle."""
    size, numbers = F.size("vector"), [F.col(c).cast("long") for c in ("dish", "ingredient")]
    count, keys, least, most, holes = vectors.where(size > 0).agg(F.count("*"), F.countDistinct("ingredient"), F.min(size), F.max(size), F.count_if(F.exists("vector", lambda v: v.isNull()))).first()
    whole_numbers = {dict(x.dtypes)[c] for x, c in ((rows, "dish"), (rows, "ingredient"), (vectors, "ingredient"))} <= {"int", "bigint"}
    if whole_numbers and count == keys and count and least == most and not holes:
        numbered_rows = rows.where("ingredient is not null").select(F.col("dish").isNull().alias("none"), F.coalesce(numbers[0], F.lit(0)).alias("dish"), numbers[1], F.col("weight").cast("double").alias("weight"))
        asked, schema = numbered_rows.repartition("none", "dish").sortWithinPartitions("none", "dish"), f"dish {dict(rows.dtypes)['dish']}, vector array<double>"
        if count * most <= BROADCAST_NUMBERS:
            held = vectors.where(size > 0).select(numbers[1], F.col("vector").cast("array<double>")).orderBy("ingredient").collect()  # within the bound above
            sent = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held])))
            return asked.mapInArrow(_means(sent), schema)
        single = dict(vectors.dtypes)["vector"] == "array<float>"
        if count * most * (4 if single else 8) <= READ_BYTES:
            packed = vectors.where(size > 0).select(numbers[1], F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"))
            return _faced(asked, packed, max(1, -(-count * most * (4 if single else 8) // PART_BYTES))).mapInArrow(_sums, schema)
    x = rows.join(vectors, "ingredient").select("dish", "weight", F.posexplode("vector").alias("d", "v"))
    sums = x.groupBy("dish", "d").agg(F.sum(F.col("weight") * F.col("v")).alias("s"))
    whole = sums.groupBy("dish").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda y: y["s"]).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, y: a + y * y))
    return whole.select("dish", F.transform("s", lambda y: F.try_divide(y, norm)).alias("vector"))


def _unit(key: np.ndarray, none: np.ndarray, total: np.ndarray, weighed: np.ndarray) -> pa.RecordBatch:
    norm = np.sqrt((total * total).sum(axis=1))
    bad = ~weighed | (norm == 0)
    values = pa.array((total / np.where(bad, 1, norm)[:, None]).ravel(), mask=np.repeat(bad, total.shape[1]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * total.shape[1]), values)
    return pa.RecordBatch.from_arrays([pa.array(key, mask=none), lists], ["dish", "vector"])


def _run_on(open_dish: list[np.ndarray] | None, found: list[np.ndarray]) -> list[np.ndarray]:
    """Dishes (key, none, total, weighed) with the last of those before, which may be the first of these."""
    if open_dish is None:
        return found
    if open_dish[0][0] == found[0][0] and open_dish[1][0] == found[1][0]:
        found[2][0] += open_dish[2][0]
        found[3][0] |= open_dish[3][0]
        return found
    return [np.concatenate(x) for x in zip(open_dish, found, strict=True)]


def _means(sent: Broadcast):
    """Rows (none, dish, ingredient, weight) in order of dish to unit vectors; a dish may run on over batches."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        open_dish = None
        for batch in batches:
            for top in range(0, batch.num_rows, 8192):
                part = batch.slice(top, 8192)
                place = np.minimum(np.searchsorted(ids, wanted := part.column("ingredient").to_numpy()), len(ids) - 1)
                met = ids[place] == wanted
                if not met.any():
                    continue
                none, key = part.column("none").to_numpy(zero_copy_only=False)[met], part.column("dish").to_numpy()[met]
                weighed = part.column("weight").is_valid().to_numpy(zero_copy_only=False)[met]
                weight = part.column("weight").fill_null(0).to_numpy()[met]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (none[1:] != none[:-1])))
                total = np.add.reduceat(np.where(weighed[:, None], vectors[place[met]] * weight[:, None], 0), first)
                found = _run_on(open_dish, [key[first], none[first], total, np.logical_or.reduceat(weighed, first)])
                open_dish = [x[-1:] for x in found]
                if len(found[0]) > 1:
                    yield _unit(*[x[:-1] for x in found])
        if open_dish is not None:
            yield _unit(*open_dish)

    return means


def _faced(asked: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """Rows in order of dish, ``LINES`` at a time, against all parts of the vectors (p, held), one after another. Each task
    reads the parts where they are packed."""
    ship(asked.sparkSession)
    lines = LINES
    part = F.pmod(F.xxhash64("ingredient"), F.lit(parts)).cast("int")
    packed = checkpointed(vectors.groupBy(part.alias("p")).agg(F.collect_list(F.struct("ingredient", "vector")).alias("held")))
    names = ["none", "dish", "ingredient", "weight", "part"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, 0
        row = lambda x: pa.RecordBatch.from_arrays([pa.array([block]), *[pa.ListArray.from_arrays([0, len(x)], x.column(c).combine_chunks()) for c in names]], ["block", *names])
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= lines:
                whole = pa.Table.from_batches(held)
                yield row(whole.slice(0, lines))
                held, n, block = whole.slice(lines).to_batches(), n - lines, block + 1
        if n:
            yield row(pa.Table.from_batches(held))

    rows = asked.withColumn("part", part).mapInArrow(pack, "block long, none array<boolean>, dish array<bigint>, ingredient array<bigint>, weight array<double>, part array<int>")
    return rows.crossJoin(packed.coalesce(1).hint("shuffle_replicate_nl"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_faced`` gives to unit vectors; a dish may run on over blocks of rows."""
    open_dish = found = block = None
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("block")[k].as_py() != block:
                block = batch.column("block")[k].as_py()
                if found is not None and met.any():
                    whole = _run_on(open_dish, [x[met] for x in found])
                    open_dish = [x[-1:] for x in whole]
                    for top in range(0, len(whole[0]) - 1, 8192):
                        yield _unit(*[x[:-1][top : top + 8192] for x in whole])
                none, dish, wanted, weight, part = (batch.column(c)[k].values for c in ("none", "dish", "ingredient", "weight", "part"))
                none, dish, wanted, part, weighed = none.to_numpy(zero_copy_only=False), dish.to_numpy(), wanted.to_numpy(), part.to_numpy(), weight.is_valid().to_numpy(zero_copy_only=False)
                weight = weight.fill_null(0).to_numpy()
                new = np.append(True, (dish[1:] != dish[:-1]) | (none[1:] != none[:-1]))
                at, order = np.cumsum(new) - 1, np.argsort(part, kind="stable")
                part, met, found = part[order], np.zeros(at[-1] + 1, bool), None
            held = batch.column("held")[k].values
            ids = held.field("ingredient").to_numpy()
            vectors = held.field("vector").flatten().to_numpy().reshape(len(ids), -1)
            if found is None:
                found = [dish[new], none[new], np.zeros((len(met), vectors.shape[1])), np.zeros(len(met), bool)]
            own = order[slice(*np.searchsorted(part, [p := batch.column("p")[k].as_py(), p + 1]))]
            by_id = np.argsort(ids)
            for top in range(0, len(own), 8192):
                rows = own[top : top + 8192]
                place = by_id[np.minimum(np.searchsorted(ids, wanted[rows], sorter=by_id), len(ids) - 1)]
                there = ids[place] == wanted[rows]
                if there.any():
                    rows, place = rows[there], place[there]
                    u = at[rows]
                    heads = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                    found[2][u[heads]] += np.add.reduceat(np.where(weighed[rows, None], vectors[place] * weight[rows, None], 0), heads)
                    found[3][u[heads]] |= np.logical_or.reduceat(weighed[rows], heads)
                    met[u] = True
    if found is not None and met.any():
        open_dish = _run_on(open_dish, [x[met] for x in found])
    if open_dish is not None:
        for top in range(0, len(open_dish[0]), 8192):
            yield _unit(*[x[top : top + 8192] for x in open_dish])


def weighted_vote(rows: DataFrame, key: str, label: Column, weight: Column, default: str) -> DataFrame:
    """The label with most weight per key; ties go to the first in order."""
    sums = rows.select(key, label.alias("label"), weight.alias("w")).groupBy(key, "label").agg(F.sum("w").alias("w"))
    best = sums.groupBy(key).agg(F.min_by("label", F.struct(F.col("label").isNull(), -F.col("w"), F.col("label"))).alias("label"))
    return best.withColumn("label", F.coalesce("label", F.lit(default)))


def scaled(rows: DataFrame, columns: dict[str, Column], top: float = 1000.0) -> DataFrame:
    """``rows`` with columns from 0 to ``top`` between the least and the greatest value; where these agree the span
    counts as 1. The ends are taken by an aggregation, so no task sees all rows."""
    ends = rows.agg(*[x for n, c in columns.items() for x in (F.min(c).alias(f"{n} low"), F.max(c).alias(f"{n} high"))]).first()
    span = lambda n: (ends[f"{n} high"] - ends[f"{n} low"]) or 1.0
    known = {n: c for n, c in columns.items() if ends[f"{n} low"] is not None}
    return rows.withColumns({n: F.round((c - F.lit(ends[f"{n} low"])) / F.lit(span(n)) * top, 2) if n in known else F.lit(None).cast("double") for n, c in columns.items()})


def rank_share(rows: DataFrame, column: str, name: str = "share") -> DataFrame:
    """``rows`` with the share of values that are less, among those that are not null; null for null."""
    known, order = F.col(column).isNotNull(), F.monotonically_increasing_id()
    placed = ranked(rows.where(known).select(F.struct("*").alias("whole"), F.col(column).alias("v"), order.alias("t")), [], F.col("v"), F.col("t"))
    share = placed.select("whole.*", ((F.col("rank") - 1) / F.col("n")).alias(name))
    return share.unionByName(rows.where(~known).select("*", F.lit(None).cast("double").alias(name)))


def colour_ranks(rows: DataFrame, category: str) -> DataFrame:
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), category)) - 1)


def search(rows: DataFrame, name: str, text: str, count: str, most: int) -> DataFrame:
    return rows.where(F.contains(F.lower(name), F.lit(text.lower()))).orderBy(F.desc(count), name).limit(most)


def nearest_point(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d", d).where(F.col("d") <= radius * radius).orderBy("d", "idx").limit(1)


def contribution_bars(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.withColumn("bar", F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(key))))


def distinctive_tokens(rows: DataFrame, group: str, tokens: Column, generic: Iterable[str], top: int = 6) -> DataFrame:
    """Words that mark a group: frequency in the group times log of rarity, generic ones at a quarter."""
    x = rows.select(group, F.explode(F.array_distinct(tokens)).alias("token"))
    tf = x.groupBy(group, "token").agg(F.count("*").alias("tf"))
    groups = tf.select(group).distinct().count()
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    score = F.col("tf") * F.log((F.lit(groups) + 1.0) / (F.col("df") + 0.5)) * F.when(F.col("token").isin(*generic), 0.25).otherwise(1.0)
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), F.desc("token"))
    return tf.join(df, "token").withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "rank", "token", "score")


def gazetteer(rows: DataFrame, region: str) -> DataFrame:
    """Dishes, mean logarithm of counts, centre and total of each region."""
    return rows.where(F.col(region) >= 0).groupBy(region).agg(F.count("*").alias("n"), F.avg(F.log10(F.col("count"))).alias("mean_log"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("count").alias("total"))


def density_grid(rows: DataFrame, cells: int = 600, span: float = 1000.0) -> DataFrame:
    """Sum of log counts per cell of a square grid."""
    cell = lambda c: F.least(F.floor(F.col(c) / span * cells), F.lit(cells - 1)).cast("int")
    return rows.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.sum(F.log10(F.col("count") + 1)).alias("weight"))


def smoothed_grid(grid: DataFrame, sigma: int = 2) -> DataFrame:
    """Gaussian smoothing, one direction after the other; each cell spreads to its neighbours only."""
    reach = 3 * sigma
    for c in ("cx", "cy"):
        kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(np.exp(-d * d / (2 * sigma * sigma)) / (sigma * np.sqrt(2 * np.pi)))).alias("k")) for d in range(-reach, reach + 1)])
        x = grid.withColumn("s", F.explode(kernel)).withColumn(c, F.col(c) + F.col("s.d")).withColumn("weight", F.col("weight") * F.col("s.k"))
        grid = x.groupBy("cx", "cy").agg(F.sum("weight").alias("weight"))
    return grid


def detail_records(meta: DataFrame, **parts: DataFrame) -> DataFrame:
    """All that is known of a dish as one row: ``meta`` with each part (cluster_id, ...) nested under its name."""
    out = meta
    for name, part in parts.items():
        nested = part.select("cluster_id", F.struct(*[c for c in part.columns if c != "cluster_id"]).alias(name))
        out = out.join(nested, "cluster_id", "left")
    return out


def clade_label(text: Column, words: int = 4) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, "[\"'`.]", "")), "\\s+"), 1, words), " ")


def projection(dishes: DataFrame, top: float = 1000.0) -> DataFrame:
    """idx, x and y: the two principal components of the vectors, scaled to 0 to ``top``.

    A stand-in for projections that cannot be reproduced; it keeps large distances, not neighbourhoods.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = dishes.select("idx", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(x).transform(x).select("idx", vector_to_array("p").alias("p"))
    return scaled(p, {"x": F.get("p", F.lit(0)), "y": F.get("p", F.lit(1))}, top).select("idx", "x", "y")


def overlaid(rows: DataFrame, lost_years: str, classes: Iterable[str], default: str = "other") -> DataFrame:
    """Health as the negative of lost years, and classes that are missing by their default."""
    return rows.withColumn("health", -F.col(lost_years)).withColumns({c: F.coalesce(c, F.lit(default)) for c in classes})


def enriched_leaves(edges: DataFrame, dishes: DataFrame) -> DataFrame:
    """Edges (parent, child, is_leaf) of a tree; leaves get the columns of the dish whose idx they are."""
    return edges.join(dishes, (F.col("child") == F.col("idx")) & F.col("is_leaf"), "left").drop("idx")


def clade_members(clades: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent dishes of each clade (clade, name, count), and its size."""
    w = Window.partitionBy("clade")
    return clades.withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "name"))).withColumn("size", F.count("*").over(w)).where(F.col("rank") <= top)


# Parts of ingredients' names by class, in order, and names that are of no class.
PROTEINS = (
    ("fish", ("fish", "shrimp", "prawn", "salmon", "tuna", "cod", "tilapia", "crab", "lobster", "scallop", "calamari", "squid", "clam", "mussel", "anchov", "halibut", "catfish", "mahi", "snapper", "trout", "seafood", "octopus", "crawfish", "haddock", "sardine", "eel")),
    ("lamb", ("lamb", "mutton", "goat")),
    ("turkey", ("turkey",)),
    ("chicken", ("chicken",)),
    ("beef", ("beef", "steak", "brisket", "sirloin", "veal")),
    ("pork", ("pork", "bacon", "ham", "sausage", "prosciutt", "chorizo", "pancetta", "pepperoni", "salami", "carnitas")),
    ("egg", ("egg",)),
    ("tofu", ("tofu", "tempeh", "seitan", "edamame")),
    ("beans", ("bean", "chickpea", "garbanzo", "lentil")),
    ("cheese", ("cheese", "paneer", "feta", "mozzarella", "cheddar", "parmesan", "ricotta", "queso", "gouda", "provolone")),
)
NO_PROTEIN = ("stock", "broth", "bouillon", "sauce", "powder", "seasoning")
PROTEIN_BUT = {"egg": ("eggplant", "noodle"), "beans": ("green bean", "string bean", "bean sprout", "vanilla bean", "coffee bean", "cocoa bean")}
CARBS = (
    ("potato", ("potato", "fries", "hash brown", "tater", "yam", "cassava", "yuca", "plantain")),
    ("corn", ("corn", "masa", "polenta", "hominy", "grits", "cornmeal")),
    ("rice", ("rice",)),
    ("wheat", ("bread", "pasta", "flour", "tortilla", "noodle", "spaghetti", "macaroni", "bun", "dough", "naan", "pita", "couscous", "bulgur", "crust", "wrap", "biscuit", "cracker", "orzo", "gnocchi", "udon", "ramen", "vermicelli")),
)
NO_CARB = ("cornstarch", "rice vinegar", "rice wine", "rice paper")


def class_of(ingredient: Column, rules: Iterable[tuple[str, Iterable[str]]], none: Iterable[str], but: dict[str, Iterable[str]] | None = None) -> Column:
    """The first class with a part of its in the name, unless the name has one of the class's exceptions; null for names
    of no class."""
    name = F.lower(F.coalesce(ingredient, F.lit("")))
    hit = lambda label, parts: contains_any(name, parts) & ~contains_any(name, but[label]) if but and label in but else contains_any(name, parts)
    return F.when(~contains_any(name, none), F.coalesce(*[F.when(hit(label, parts), F.lit(label)) for label, parts in rules]))


def primary_class(rows: DataFrame, kind: Column, default: str = "none") -> DataFrame:
    """The class with most grams of each recipe, the one named first of equals; rows of no class do not count."""
    sums = rows.select("recipe_id", kind.alias("class"), F.coalesce("grams", F.lit(0.0)).alias("g"), "position").groupBy("recipe_id", "class").agg(F.sum("g").alias("g"), F.min("position").alias("p"))
    return sums.groupBy("recipe_id").agg(F.coalesce(F.min_by("class", F.when(F.col("class").isNotNull(), F.struct(-F.col("g"), F.col("p"), F.col("class")))), F.lit(default)).alias("class"))
