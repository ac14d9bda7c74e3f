import pytest
from pyspark.sql import functions as F

from platelab.functions import scores as S
from platelab.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,key",
    [
        ("8 country ribs", "ribs ry"), ("3 packs wings", "s wings"), ("ten wings", "wings"), ("chicken tenders", "chicken tenders"), ("platter w/ bacon", "bacon platter w"), ("platter w/bacon", "bacon platter"),
        ("#13 Large Pizza (vegan)", "pizza"), ("The Pizza of the Pizza &amp; Ham", "ham pizza pizza"), ("Pizza &amp;amp; Ham", "amp ham pizza"), ("8 oz steak", "oz steak"), ("", ""), (None, ""),
    ],
)
def test_normalize(spark, name, key):
    assert one(spark, T.normalize(F.col("n").cast("string")), n=name) == key


def test_formats(spark):
    for category, want in {"Wraps": "wrap", "Subs & Wraps": None, "Po'Boys": "sub", "Soups": "soup", "Other": None, None: None}.items():
        assert one(spark, T.format_of(F.col("c").cast("string")), c=category) == want
    key = T.normalize_with_format(F.col("n"), F.col("c").cast("string"))
    assert one(spark, key, n="tuna wraps tuna", c="Wraps") == "tuna wrap"
    assert one(spark, key, n="tuna wraps tuna", c=None) == "tuna tuna wraps"
    assert one(spark, T.lookup_key(F.col("n"), F.col("c"), {"hoagie": "sub"}), n="ham hoagie sub", c="Drinks") == "ham sub"
    assert one(spark, T.lookup_key(F.col("n"), F.col("c"), {}), n="the", c="Drinks") is None


def test_singular(spark):
    for word, want in {"parties": "party", "boxes": "box", "sandwiches": "sandwich", "tomatoes": "tomato", "burgers": "burger", "glass": "glass", "bus": "bus", "pies": "pie"}.items():
        assert one(spark, T.singular(F.col("w")), w=word) == want


def test_prices_and_tags(spark):
    assert [one(spark, T.parse_price(F.col("p").cast("string")), p=p) for p in ("9.99 USD", "-1 USD", "9.99", "x USD", None)] == [9.99, -1.0, None, None, None]
    assert one(spark, T.tags(F.col("t")), t=" a, b ,,c") == ["a", "b", "c"]
    assert one(spark, T.html_unescape(F.col("h")), h="a &AMP;amp; b &lt;&#x2F;") == "a & b </"
    assert one(spark, T.sentinel_to_null(F.col("h")), h="$" * 17) is None


def test_fragments_and_numbers(spark):
    assert [one(spark, T.is_fragment(F.col("n")), n=n) for n in ("a a a", "a a b b", "a a b", " ".join(map(str, range(13))), "")] == [True, True, False, True, False]
    assert [one(spark, T.strip_number_tokens(F.col("n")), n=n) for n in ("12pc nuggets", "8 dinner piece", "plain name", "12 pc")] == ["nuggets", "dinner", None, ""]


def test_code_fence(spark):
    for text in ('```json\n{"a": 1}\n```', 'Here: {"a": 1} ok', '{"a": 1}'):
        assert one(spark, F.from_json(T.strip_code_fence(F.col("t")), "a int")["a"], t=text) == 1
    assert one(spark, T.strip_code_fence(F.col("t")), t="none") is None


def profile(spark, **v):
    names = ("energy_kcal", "sugars_g", "saturated_g", "sodium_mg", "protein_g", "fibre_g", "fruit_share", "fat_g")
    args = [F.lit(float(v.get(n, 0))) for n in names]
    return one(spark, S.nutri_score(*args, F.lit(v.get("kind", "general")), F.lit(v.get("water", False))))


def test_profiles(spark):
    assert profile(spark, kind="beverage", water=True)["grade"] == "A"
    sweet = profile(spark, energy_kcal=42, sugars_g=10.6, kind="beverage")
    assert sweet["grade"] == "E" and sweet["score"] == 14
    dense = dict(energy_kcal=500, sugars_g=30, saturated_g=12, sodium_mg=800, protein_g=20, fibre_g=1)
    assert profile(spark, **dense)["protein_counted"] is False and profile(spark, **dense, kind="cheese")["protein_counted"] is True
    assert profile(spark, fruit_share=90, fibre_g=5, protein_g=4)["score"] == -12
    assert profile(spark, saturated_g=5, fat_g=10, kind="fat")["saturated_points"] == 7
    assert profile(spark)["score_0to100"] == pytest.approx(27.27)


def test_food_groups(spark):
    for name, fruit, group in [
        ("Apples, raw", "fruit", "fruits"), ("Potato, boiled", "none", "other"), ("Oil, olive oil", "oil", "other"), ("Oil, corn", "none", "other"), ("Tofu", "legume", "legumes"), ("Vegan chicken", "none", "other"), ("Ham, sliced", "none", "processed_meat"),
        ("Beef broth", "none", "other"), ("Rice, brown", "none", "whole_grains"), ("Goat with oats", "none", "other"), (None, "none", "other"),
    ]:
        d = F.lit(name).cast("string")
        assert one(spark, S.fruit_class(d, F.lit(""))) == fruit, name
        assert one(spark, S.diet_group(d, F.lit(""))) == group, name


def test_letters(spark):
    assert [one(spark, S.letter(F.lit(v))) for v in (1.5, 1.6, 3.5, 4.5, 4.6)] == ["A", "B", "C", "D", "F"]
