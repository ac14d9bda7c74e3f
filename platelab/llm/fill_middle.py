"""Fill-in-middle transformation in Spark's own functions, and its way back.

A text's units are its code points. Two cuts, taken from a digest of the document's id, part it into prefix, middle
and suffix, which are put together with a sentinel before each: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or
``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm). A share of the documents, and every text that is empty or holds a
sentinel itself, stays plain. No sentinel can arise across a border, as none begins with the end of another; so the
way back splits at the sentinels.

Defined results: null text counts as empty; a null doc_id counts as an empty id; very long texts are handled whole,
with some tens of bytes of memory for each code point; rows of the same id are cut by the same digest; an empty table
gives an empty result; other columns are left alone and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
#: Of 100 documents so many are rearranged, and of 100 rearranged so many have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20


def transform(docs: DataFrame, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (null if plain) and output, in place of columns so named.

    Each whole input row is the struct ``row``.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    parted = (
        nested(docs, digest.alias("digest"), text.alias("text"))
        .select("*", units.alias("units"), *[x.alias(f"h{k + 1}") for k, x in enumerate(h)])
        .select("*", F.size("units").cast("long").alias("n"))
        .select("*", (F.col("h1") % (F.col("n") + 1)).alias("c1"), (F.col("h2") % (F.col("n") + 1)).alias("c2"))
        .select("*", F.least("c1", "c2").cast("int").alias("a"), F.greatest("c1", "c2").cast("int").alias("b"))
    )
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINELS) | (F.col("h3") % 100 >= rearranged)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start, length), "")

    a, b, n = F.col("a"), F.col("b"), F.col("n").cast("int")
    prefix, middle, suffix = part(F.lit(1), a), part(a + 1, b - a), part(b + 1, n - b)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return parted.select("*", form.alias("form")).select(
        "row", "n", "form", F.when(moved, a.cast("long")).alias("prefix_chars"), F.when(moved, (b - a).cast("long")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from what the transformation made of it."""
    parts = F.split(output, SENTINELS, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and digests of the output and of the text restored from it."""
    done = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
