"""Quality rules whose thresholds adapt to each language and source.

Every document is measured once. A mergeable quantile sketch (a histogram whose buckets have a bounded relative
width, so sketches merge by adding counts) holds each measure's distribution per (lang, source), per lang and over
all. A group's distribution is shrunk towards its parent's: to its own documents come ``PRIOR`` documents of its
language, whose distribution has got ``PRIOR`` documents of all, so small groups lean on their language and large ones
stand for themselves. A fence lies ``REACH`` times the distance from median to quartile beyond the quartile, on the side
in question; it stays put while less than a quarter of a group is junk. The filter joins documents with their group's
fences. No threshold is fixed and no label is looked at.

Counts of finds (symbols, repeated lines, repeated words) are taken as rates. What one find alone makes of a rate says
more about a text's length than about its quality. So each text enters the sketch with one find more than it has and is
judged with one less.

Defined results: null text counts as empty; null lang or source is a group of its own; rows that repeat are measured
and judged alike, and so are equal texts of one group; very long texts are measured whole, in one task each; a group
whose documents are all alike has fences one bucket away; an empty table gives an empty result; further columns of the
input, whatever their names, are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, counted_side, nested, prepare, turn_to

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Documents of the parent group that come to each group.
PRIOR = 100
REACH = 10
SHARE = 1_000_000
#: Each measure's count, what the count is per, and how much one find adds to it (two windows of three words repeat).
MEASURES = {"symbol_rate": ("n_symbols", "word_chars", 1), "dup_line_rate": ("n_dup_lines", "n_words", 1), "repeat_rate": ("n_repeat_words", "n_words", 6), "word_length": ("word_chars", "n_words", 0)}
#: Measures of which too little is a fault as well.
TWO_SIDED = ("word_length",)
SUB_BITS = 7

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_MEASURED = T.StructType([T.StructField(c, T.LongType(), False) for c in _COUNTS])
_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more; exact, on numbers in place of words."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    different = len(number)
    if different < 1 << 20:
        windows = (ids[:-2] * different + ids[1:-1]) * different + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * different + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * different + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] = again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows of three, lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated = repeat_words(words)
    return len(words), chars, symbols, dup_lines, repeated, lines


def measured(text: Column) -> Column:
    """The six counts of ``measure_text`` as a struct.

    Spark takes a filter on what a deterministic function gave below the place where that is made, and makes it twice: in
    two workers for each core. So this one counts as not deterministic.
    """

    @F.arrow_udf(_MEASURED)
    def of(texts: pa.Array) -> pa.Array:
        turn_to("quality_rules")
        rows = [measure_text(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COUNTS))], fields=[pa.field(c, pa.int64(), False) for c in _COUNTS])

    return of.asNondeterministic()(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def bucket(value: Column) -> Column:
    """Lower edge of a value's bucket: its highest ``SUB_BITS`` bits, so that widths stay under 1/64 of the value."""
    shift = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _rate(m: Column, name: str, finds: int) -> Column:
    """A measure in millionths with so many finds more than there are; integers, so that every engine finds the same."""
    count, per, one = MEASURES[name]
    return F.call_function("div", SHARE * F.greatest(m[count] + finds * one, F.lit(0)), m[per])


def sketches(measures: DataFrame) -> DataFrame:
    """Bucket counts by (lang, source) and measure; adding two of them merges them."""
    m = F.struct(*_COUNTS)
    long = measures.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(_rate(m, n, 1)).alias("edge")) for n in MEASURES])).alias("x"))
    return long.groupBy("lang", "source", "x.measure", "x.edge").agg(F.count("*").alias("n"))


def _shares(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """What part of a group's weight each bucket holds, in millionths."""
    total = F.sum("w").over(Window.partitionBy(*groups, "measure"))
    return sketch.select(*groups, "measure", "edge", F.floor(SHARE * (F.col("w").cast("double") / total)).cast("long").alias("share"))


def _shrunk(sketch: DataFrame, groups: list[str], shares: DataFrame, parent: list[str]) -> DataFrame:
    """``sketch`` (groups, measure, edge, n) as weights, with ``PRIOR`` documents of the parent's shares for each group."""
    named = shares.withColumnsRenamed({c: f"p_{c}" for c in (*parent, "measure")})
    same = F.col("measure") == F.col("p_measure")
    for c in parent:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    prior = sketch.select(*groups, "measure").distinct().join(named, same).select(*groups, "measure", "edge", (PRIOR * F.col("share")).alias("w"))
    own = sketch.select(*groups, "measure", "edge", (SHARE * F.col("n")).alias("w"))
    return own.unionByName(prior).groupBy(*groups, "measure", "edge").agg(F.sum("w").alias("w"))


def fences(measures: DataFrame) -> DataFrame:
    """One row per (lang, source) with ``<measure>_max`` and, if two-sided, ``<measure>_min``. A group's buckets are few whatever its size."""
    fine = checkpointed(sketches(measures))
    by_lang = fine.groupBy("lang", "measure", "edge").agg(F.sum("n").alias("n"))
    over_all = by_lang.groupBy("measure", "edge").agg(F.sum("n").alias("w"))
    lang = _shrunk(by_lang, ["lang"], _shares(over_all, []), [])
    both = ["lang", "source"]
    group = _shrunk(fine, both, _shares(lang, ["lang"]), ["lang"])
    w = Window.partitionBy(*both, "measure")
    found = group.select(*both, "measure", "edge", F.sum("w").over(w).alias("total"), F.sum("w").over(w.orderBy("edge")).alias("upto"))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("total"), F.col("edge")))
    quartiles = found.groupBy(*both, "measure").agg(at(1).alias("low"), at(2).alias("mid"), at(3).alias("high"))
    least = F.call_function("shiftright", F.col("mid"), F.lit(SUB_BITS - 1))  # the width of a bucket
    most = F.col("high") + REACH * F.greatest(F.col("high") - F.col("mid"), least)
    fewest = F.col("low") - REACH * F.greatest(F.col("mid") - F.col("low"), least)
    return quartiles.groupBy(*both).agg(
        *[F.max(F.when(F.col("measure") == n, most)).alias(f"{n}_max") for n in MEASURES],
        *[F.max(F.when(F.col("measure") == n, fewest)).alias(f"{n}_min") for n in TWO_SIDED],
    )


def _within(m: Column, f: str) -> Column:
    """Whether measures lie within the joined fences ``f``."""
    ok = F.lit(True)
    for n in MEASURES:
        ok = ok & (_rate(m, n, -1) <= F.col(f"{f}.{n}_max"))
    for n in TWO_SIDED:
        ok = ok & (_rate(m, n, 1) >= F.col(f"{f}.{n}_min"))
    return ok


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    prepare(docs.sparkSession)
    m = docs.select("doc_id", "lang", "source", measured(F.col("text")).alias("m"))
    return m.select("doc_id", "lang", "source", "m.*", base_failed(F.col("m")).alias("base_failed"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``base_failed`` and ``kept``.

    Fences are drawn from all documents that pass the base rules.
    """
    m = checkpointed(measures(docs))
    f = counted_side(fences(m.where(~F.col("base_failed"))))
    same = F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source"))
    counts = F.struct(*[F.col(f"d.{c}") for c in _COUNTS])
    return m.alias("d").join(f.alias("f"), same, "left").select("doc_id", *_COUNTS[:5], "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(_within(counts, "f"), F.lit(True))).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; measures are taken again rather than joined by key."""
    prepare(docs.sparkSession)
    f = counted_side(fences(measures(docs).where(~F.col("base_failed"))))
    d = nested(docs, F.col("lang"), F.col("source"), measured(F.col("text")).alias("m")).alias("d")
    same = F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source"))
    return d.where(~base_failed(F.col("m"))).join(f.alias("f"), same, "left").where(F.coalesce(_within(F.col("d.m"), "f"), F.lit(True))).select("d.row.*")


def _sql() -> str:
    """Quartiles by joining each bucket with those up to it, in place of running sums; counts from lists of words."""
    values = "unnest([" + ", ".join(f"{{'measure': '{n}', 'v': {SHARE} * ({c} + {one}) // {per}}}" for n, (c, per, one) in MEASURES.items()) + "])"
    edge = f"(x.v >> greatest(length(bin(x.v)) - {SUB_BITS}, 0)) << greatest(length(bin(x.v)) - {SUB_BITS}, 0)"
    most = ", ".join(f"max(CASE WHEN measure = '{n}' THEN q3 + {REACH} * greatest(q3 - q2, q2 >> {SUB_BITS - 1}) END) AS {n}_max" for n in MEASURES)
    fewest = ", ".join(f"max(CASE WHEN measure = '{n}' THEN q1 - {REACH} * greatest(q2 - q1, q2 >> {SUB_BITS - 1}) END) AS {n}_min" for n in TWO_SIDED)
    ok = " AND ".join([f"{SHARE} * greatest({c} - {one}, 0) // {per} <= {n}_max" for n, (c, per, one) in MEASURES.items()] + [f"{SHARE} * ({MEASURES[n][0]} + {MEASURES[n][2]}) // {MEASURES[n][1]} >= {n}_min" for n in TWO_SIDED])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ls AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
li AS (SELECT r, sum(c - 1) AS dup FROM ls GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(li.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN wc USING (r) LEFT JOIN li USING (r) LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c),
u AS (SELECT lang, source, {values} AS x FROM m WHERE NOT base_failed),
fine AS (SELECT lang, source, x.measure AS measure, {edge} AS edge, count(*) AS n FROM u GROUP BY ALL),
total AS (SELECT measure, edge, floor({SHARE} * (sum(n)::DOUBLE / any_value(t)))::BIGINT AS share FROM fine JOIN (SELECT measure, sum(n) AS t FROM fine GROUP BY measure) USING (measure) GROUP BY measure, edge),
l AS (SELECT lang, measure, edge, sum(w) AS w FROM (SELECT lang, measure, edge, {SHARE} * n AS w FROM fine
    UNION ALL SELECT lang, measure, edge, {PRIOR} * share FROM (SELECT DISTINCT lang, measure FROM fine) JOIN total USING (measure)) GROUP BY ALL),
s AS (SELECT l.lang, l.measure, edge, floor({SHARE} * (w::DOUBLE / t))::BIGINT AS share FROM l JOIN (SELECT lang, measure, sum(w) AS t FROM l GROUP BY ALL) k ON l.lang IS NOT DISTINCT FROM k.lang AND l.measure = k.measure),
b AS (SELECT lang, source, measure, edge, sum(w)::BIGINT AS w FROM (SELECT lang, source, measure, edge, {SHARE} * n AS w FROM fine
    UNION ALL SELECT k.lang, k.source, k.measure, edge, {PRIOR} * share FROM (SELECT DISTINCT lang, source, measure FROM fine) k JOIN s ON k.lang IS NOT DISTINCT FROM s.lang AND k.measure = s.measure) GROUP BY ALL),
upto AS (SELECT a.lang, a.source, a.measure, a.edge, sum(CASE WHEN z.edge <= a.edge THEN z.w ELSE 0 END) AS w, sum(z.w) AS t
    FROM b a JOIN b z ON a.measure = z.measure AND a.lang IS NOT DISTINCT FROM z.lang AND a.source IS NOT DISTINCT FROM z.source GROUP BY ALL),
q AS (SELECT lang, source, measure, min(edge) FILTER (4 * w >= t) AS q1, min(edge) FILTER (4 * w >= 2 * t) AS q2, min(edge) FILTER (4 * w >= 3 * t) AS q3 FROM upto GROUP BY ALL),
f AS (SELECT lang, source, {most}, {fewest} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {ok} END AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


ORACLE_SQL = _sql()
