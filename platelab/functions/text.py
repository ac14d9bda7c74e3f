"""Column functions that clean, normalise and key menu text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns decide which keys names get, so they must not change.
SIZE_WORDS = "extra\\s*large|x[-\\s]?large|xl|xxl|jumbo|grande|large|medium|regular|reg|small|sm|md|lg|mini|kids?|kid'?s|family|party|individual|single|double|triple|half|whole|full|personal|junior|jr|senior|sr|petite|tall|short|venti"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
UNITS = "oz|ounces?|lb|lbs|pounds?|inch|inches|qt|quart|gal|gallon|liter|ml"
COUNTERS = "pieces?|pcs?|piece|pc\\.?|ct|count|pack"
NOISE = "new|w/|with|and|the|a|an|of|in|on"
NORMAL_STEPS = (
    ("^\\s*(?:#\\d+|\\d+[.)]|[a-z][.)])\\s+", ""),
    ("\\([^)]*\\)|\\[[^\\]]*\\]", " "),
    (f"^\\s*(?:\\d+|(?:{NUMBER_WORDS}))\\b\\s*(?:(?:{COUNTERS}))?\\s*[-:.]?\\s*", " "),
    (f"\\b(?:\\d+(?:\\.\\d+)?|(?:{NUMBER_WORDS}))\\s*-?\\s*(?:{UNITS})\\b", " "),
    (f"\\b(?:{SIZE_WORDS})\\b", " "),
    (f"\\b(?:{NOISE})\\b", " "),
    ("[^a-z0-9 ]+", " "),
)
FORMATS = (
    ("wraps?", "wrap"),
    ("(subs?|hoagies?|heroes?|grinders?|po[' ]?boys?)", "sub"),
    ("(sandwich(?:es)?|deli|paninis?|melts?|sliders?)", "sandwich"),
    ("(bowls?|poke)", "bowl"),
    ("(pizzas?|flatbreads?)", "pizza"),
    ("(calzones?|strombolis?)", "calzone"),
    ("(sushi|sashimi|nigiri|maki|temaki)", "sushi"),
    ("tacos?", "taco"),
    ("burritos?", "burrito"),
    ("quesadillas?", "quesadilla"),
    ("fajitas?", "fajita"),
    ("salads?", "salad"),
    ("(pastas?|noodles?|pho|ramen|spaghetti|fettuccine|linguine|udon|soba)", "pasta"),
    ("(burgers?|cheeseburgers?|hamburgers?)", "burger"),
    ("wings?", "wings"),
    ("(ribs?|rib)", "ribs"),
    ("(curr(?:y|ies))", "curry"),
    ("(steaks?)", "steak"),
    ("(soups?|chowders?|bisques?|stews?)", "soup"),
)
WRONG_CASE_ENTITY = re.compile("&(amp|quot|apos|lt|gt|nbsp);", re.IGNORECASE)


def html_unescape(text: Column, rounds: int = 5, wrong_case: bool = True) -> Column:
    """Decode HTML entities until nothing changes, at most ``rounds`` times; names in the wrong case count too if
    ``wrong_case`` is set."""

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        out = []
        for value in values:
            s = value.as_py()
            for _ in range(rounds if s and "&" in s else 0):
                plain = html.unescape(WRONG_CASE_ENTITY.sub(lambda m: m[0].lower(), s) if wrong_case else s)
                if plain == s:
                    break
                s = plain
            out.append(s)
        return pa.array(out, pa.string())

    return decode(text)


def tokens(text: Column) -> Column:
    """Words between spaces; an empty array for empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda t: t != "")


def joined(array: Column) -> Column:
    return F.array_join(array, " ")


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalize(name: Column, unescape: bool = True) -> Column:
    """Sorted lower-case words of a name without numbering, counts, measures, sizes and noise; duplicates stay.

    Entities are decoded once, so what was escaped twice keeps its entity's name as a word.
    """
    text = F.lower(html_unescape(name, rounds=1, wrong_case=False) if unescape else name)
    text = reduce(lambda t, step: F.regexp_replace(t, F.lit("(?i)" + step[0]), F.lit(step[1])), NORMAL_STEPS, text)
    return joined(F.array_sort(tokens(text)))


def format_of(category: Column) -> Column:
    """The dish format that a menu category names, if it names exactly one."""
    named = F.array_compact(F.array(*[F.when(category.rlike(f"(?i)\\b{pattern}\\b"), F.lit(token)) for pattern, token in FORMATS]))
    return F.when(F.size(F.array_distinct(named)) == 1, F.get(named, F.lit(0)))


def singular_format(word: Column) -> Column:
    """A word that is a format with an ending of the plural becomes that format."""
    stems = [F.regexp_replace(word, ending, stem) for ending, stem in (("s$", ""), ("es$", ""), ("ies$", "y"))]
    return F.coalesce(*[F.when((s != word) & s.isin(*[token for _, token in FORMATS]), s) for s in stems], word)


def replaced(array: Column, words: Mapping[str, str]) -> Column:
    """Each word, or what it stands for."""
    if not words:
        return array
    table = F.create_map(*[F.lit(x) for pair in sorted(words.items()) for x in pair])
    return F.transform(array, lambda t: F.coalesce(F.element_at(table, t), t))


def normalize_with_format(name: Column, category: Column, unescape: bool = True) -> Column:
    """As ``normalize``; where the category names a format, that word joins in, plurals of formats become singular and
    each word stays once."""
    base, fmt = normalize(name, unescape), format_of(category)
    words = F.array_union(F.transform(tokens(base), singular_format), F.array(fmt))
    return F.when(fmt.isNull(), base).otherwise(joined(F.array_sort(F.array_distinct(words))))


def lookup_key(name: Column, category: Column, synonyms: Mapping[str, str], unescape: bool = True) -> Column:
    """Key for the alias table: each word once, synonyms replaced, sorted; null for nothing."""
    key = joined(F.array_sort(F.array_distinct(replaced(tokens(normalize_with_format(name, category, unescape)), synonyms))))
    return F.nullif(key, F.lit(""))


def sentinel_to_null(value: Column, sentinel: str = "$" * 17) -> Column:
    return F.nullif(value, F.lit(sentinel))


def parse_price(text: Column) -> Column:
    """Number in front of `` USD``; null without that ending. Negative amounts stay."""
    return F.when(text.endswith(" USD"), F.replace(text, F.lit(" USD"), F.lit("")).try_cast("double"))


def cluster_key(tag: Column, unescape: bool = True) -> Column:
    """What spellings of one category share: lower case, ``&`` and ``+`` as ``and``, single spaces."""
    text = F.lower(F.trim(html_unescape(tag) if unescape else tag))
    text = F.regexp_replace(text, "\\s*&\\s*", " and ")
    text = F.regexp_replace(text, "\\s*\\+\\s*", " and ")
    return F.regexp_replace(text, "\\s+", " ")


def singular(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(F.length(word) < 4, word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ches|shes|xes|sses|zes|oes)$"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def singular_key(text: Column) -> Column:
    return joined(F.transform(tokens(text), lambda w: singular(w)))


def tags(text: Column) -> Column:
    """Items of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def max_repeats(array: Column) -> Column:
    """How often the most frequent item occurs, and how many items occur more than once."""
    counts = F.transform(F.array_distinct(array), lambda t: F.size(F.filter(array, lambda u: u == t)))
    return F.struct(F.coalesce(F.array_max(counts), F.lit(0)).alias("most"), F.size(F.filter(counts, lambda n: n >= 2)).alias("repeated"))


def is_fragment(name: Column, most_tokens: int = 12) -> Column:
    """Too long, one word three times, or two words twice."""
    words = tokens(name)
    repeats = max_repeats(words)
    return (F.size(words) > most_tokens) | (repeats["most"] >= 3) | (repeats["repeated"] >= 2)


def strip_number_tokens(name: Column) -> Column:
    """Name without numbers, piece and inch words, sorted; null if it has none of them."""
    words = tokens(name)
    left = F.filter(words, lambda t: ~t.rlike("(?i)^(\\d+|\\d+(pc|pcs)|pc|pcs|piece|pieces|inch|in|inches)$"))
    return F.when(F.size(left) < F.size(words), joined(F.array_sort(left)))


def first_rule(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Label of the first pattern found in ``text``; null if none is."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for pattern, label in rules], F.lit(None).cast("string"))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether any of the terms occurs in ``text``, as one alternation."""
    return text.rlike("|".join(re.sub(r"([^a-zA-Z0-9 ])", r"\\\1", t) if t.isascii() else re.escape(t) for t in terms))


def strip_code_fence(text: Column) -> Column:
    """JSON inside a reply: without a code fence, else from the first brace to the last."""
    inner = F.regexp_replace(F.trim(text), "^```(?:json)?\\s*|\\s*```$", "")
    return F.when(inner.startswith("{"), inner).otherwise(F.nullif(F.regexp_extract(inner, "(?s)\\{.*\\}", 0), F.lit("")))
