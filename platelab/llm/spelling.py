"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie, and grouped by frequency.

The words form a trie. At each node the child with most words below is heavy, the others (and the end of a word, if it
is not the heavy one) are light, so a word passes at most log2(words) light edges. Two words that are one edit apart
part at one node, and one of them at least takes a light edge there. So at each of its light edges a word is merged
into the rest of the node with one character skipped (it reads the rest without the light character), replaced (by the
heavy character) or put in (the heavy character before the light one); where it then ends at the same place as another
word, the two are one edit apart. Light subtrees meet each other in the same way, with a character replaced, under the
node and what follows. Small goes into large, so all that is merged is at most a few times words x log2(words).

As Spark jobs: the trie's edges are counted by a hash of the prefix (a collision would only choose another heavy child,
which is as right), light edges are joined back to the words that pass them, and terminals that coincide are an
equi-join on the merged word. Edges that many words pass (at most ``BIG`` of them can each hold a share of 1 / ``BIG`` of
all) are broadcast, the others shuffled. Forms that lead to forms are followed from the roots down, one join a level;
counts at least double from level to level, so levels grow with the logarithm of the largest count.

Defined results: null texts have no words; a null doc_id counts as an empty id; very long texts and words are taken
whole; ties go to the smallest word in code-point order; repeated rows count as often as they stand there; a table
without words gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, prepare

#: No more than so many edges can each be passed by a share of 1 / BIG of all steps from letter to letter.
BIG = 4096
#: A form has at least so many times its word's occurrences.
TIMES = 2
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: One in so many occurrences loses a letter.
NOISE = 97


def occurrences(docs: DataFrame) -> DataFrame:
    """Words of all texts as they are counted: runs of letters in lower case (A-Z only), one in ``NOISE`` without a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    lower = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """word, n of all words long and frequent enough."""
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


_STEPS = T.StructType(
    [T.StructField(n, T.ArrayType(T.LongType() if n == "node" else T.IntegerType(), False)) for n in ("node", "letter")]
)


@F.arrow_udf(_STEPS)
def _steps(words: pa.Array) -> pa.Array:
    """For each word and each of its prefixes: a hash of the prefix, and the letter that follows (-1: the word ends).

    All prefixes of all words in one go: sums of letters times powers of an odd number, modulo 2^64, mixed with the
    prefix's length.
    """
    texts = [w + "\0" for w in words.to_pylist()]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    depth = np.arange(len(letters), dtype=np.int64) - np.repeat(starts[:-1], lengths)
    powers = np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = (letters.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)) * powers[depth]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])[:-1]
    node = sums - np.repeat(sums[starts[:-1]], lengths) if len(letters) else sums
    letters = letters.astype(np.int32)
    letters[starts[1:] - 1] = -1
    node = (node ^ (node >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + depth.astype(np.uint64)
    at = pa.array(starts, pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(at, pa.array(node.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(letters))], _STEPS.names
    )


def light_edges(words: DataFrame) -> DataFrame:
    """word, n, light: its light edges, each with the depth ``at`` and the heavy ``letter`` there (-1: the end of a word)."""
    # 128 bits stand for the word; two words that shared them would only try each other's edges too
    ids = [F.xxhash64("word").alias("w1"), F.xxhash64(F.reverse("word")).alias("w2")]
    steps = words.select(*ids, _steps("word").alias("s"))
    steps = steps.select("w1", "w2", F.posexplode(F.arrays_zip("s.node", "s.letter")).alias("at", "e")).select("w1", "w2", "at", "e.node", "e.letter")
    edges = checkpointed(steps.groupBy("node", "letter").agg(F.count("*").alias("size")))
    heavy = edges.groupBy("node").agg(F.max_by("letter", F.struct("size", "letter")).alias("heavy"), F.count("*").alias("children")).where("children > 1")
    light = checkpointed(edges.join(heavy.drop("children"), "node").where("letter <> heavy"))
    total = edges.agg(F.sum("size")).first()[0] or 0
    big = light.where(F.col("size") * BIG >= total).select("node", "letter", "heavy")
    small = light.where(F.col("size") * BIG < total).select("node", "letter", "heavy")
    # what passes a big edge, light or heavy, needs no shuffle
    few = steps.join(F.broadcast(big), ["node", "letter"])
    crowded = F.broadcast(edges.where(F.col("size") * BIG >= total).select("node", "letter"))
    rest = steps.join(crowded, ["node", "letter"], "left_anti").join(small, ["node", "letter"])
    columns = ["w1", "w2", "at", F.col("heavy").alias("letter")]
    found = few.select(*columns).unionByName(rest.select(*columns))
    by_word = found.groupBy("w1", "w2").agg(F.collect_set(F.struct("at", "letter")).alias("light"))
    return words.select("*", *ids).join(by_word, ["w1", "w2"]).select("word", "n", "light")


def near(words: DataFrame) -> DataFrame:
    """``words`` (word, n; distinct words) with n_near, and near_n and near: the near word of largest n, ties to the smallest."""
    words = words.select("word", "n")
    edges = light_edges(words).select("word", "n", F.explode("light").alias("e")).select("word", "n", "e.at", "e.letter", F.char_length("word").alias("length"))
    front, behind = F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 2, F.col("length"))
    onward, here, following = F.substring(F.col("word"), F.col("at") + 1, F.col("length")), F.substring(F.col("word"), F.col("at") + 1, F.lit(1)), F.substring(F.col("word"), F.col("at") + 2, F.lit(1))
    inside, heavy = F.col("at") < F.col("length"), F.col("letter") >= 0
    letter = F.decode(F.unhex(F.lpad(F.hex("letter"), 8, "0")), "utf-32")
    merged = checkpointed(
        edges.select(
            "word", "n", "at",
            F.when(inside, F.concat(front, behind)).alias("skipped"),
            # of a run of one letter only the last counts as skipped, so that each pair is found once
            (inside & (here != following)).alias("last"),
            F.when(inside & heavy, F.concat(front, letter, behind)).alias("replaced"),
            F.when(heavy, F.concat(front, letter, onward)).alias("longer"),
        )
    )
    tries = merged.select("word", "n", F.explode(F.array(F.when(F.col("last"), F.col("skipped")), F.col("replaced"), F.col("longer"))).alias("to")).where("to is not null")
    met = checkpointed(tries.join(words.select(F.col("word").alias("to"), F.col("n").alias("to_n")), "to"))
    first = F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word"))
    one_each = met.select("word", F.col("to").alias("a"), F.col("to_n").alias("a_n")).unionByName(met.select(F.col("to").alias("word"), F.col("word").alias("a"), F.col("n").alias("a_n")))
    links = one_each.select("word", F.lit(1).cast("long").alias("links"), first.alias("best"))

    # Light words that meet in the same place: at most one for each letter, all near each other.
    member = F.struct((-F.col("n")).alias("less"), "word")
    among = merged.where("skipped is not null").groupBy("at", "skipped").agg(F.array_sort(F.collect_list(member)).alias("all")).where("size(all) > 1")
    among = among.select(F.explode("all").alias("x"), F.get("all", F.lit(0)).alias("b1"), F.get("all", F.lit(1)).alias("b2"), (F.size("all") - 1).cast("long").alias("links"))
    best = F.when(F.col("x.word") == F.col("b1.word"), F.col("b2")).otherwise(F.col("b1"))
    grouped = among.select(F.col("x.word").alias("word"), "links", best.alias("best"))

    both = links.unionByName(grouped).groupBy("word")
    found = both.agg(F.sum("links").alias("n_near"), F.min("best").alias("b"))
    joined = words.join(found.select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.word").alias("near")), "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "near", "near_n")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each distinct word of ``words`` (word, n)."""
    prepare(words.sparkSession)
    near_words = near(checkpointed(words.select("word", "n")))
    form = F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))
    formed = checkpointed(near_words.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")))
    level = checkpointed(formed.where("form is null").select("word", F.col("word").alias("root")))
    leading = formed.where("form is not null").select("word", "form")
    roots = level
    while not level.isEmpty():
        level = checkpointed(leading.join(level.withColumnRenamed("word", "form"), "form").select("word", "root"))
        roots = roots.unionByName(level)
    return formed.join(roots, "word").select("word", "n", "n_near", "form", "form_n", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Groups of spelling variants among the words of all whole texts."""
    return grouped(counted(occurrences(docs)))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) ORDER BY k) AS t
  FROM range(256) x(k)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
), each AS (SELECT id, r, count(*) AS k, hex(encode(id || ':' || r)) AS x FROM runs GROUP BY id, r
), hashed AS (
  SELECT r, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
      lambda a, b: xor(a >> 8, list_extract(t, (xor(a, b) & 255) + 1))), CAST(4294967295 AS BIGINT)) AS h
  FROM each, bits
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), led AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, l.root FROM formed f JOIN led l ON f.form = l.word
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN led USING (word)
"""
