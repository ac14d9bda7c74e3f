"""Column functions for nutrition profiles, food groups and data quality grades."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# Fixed values of the nutrition profile: points are the number of thresholds exceeded.
KJ_PER_KCAL = 4.184
ENERGY_KJ = [335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350]
ENERGY_KJ_BEVERAGE = [0, 30, 60, 90, 120, 150, 180, 210, 240, 270]
SUGAR_G = [4.5, 9, 13.5, 18, 22.5, 27, 31, 36, 40, 45]
SUGAR_G_BEVERAGE = [0, 1.5, 3, 4.5, 6, 7.5, 9, 10.5, 12, 13.5]
SATURATED_G = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
SATURATED_SHARE = [10, 16, 22, 28, 34, 40, 46, 52, 58, 64]
SODIUM_MG = [90, 180, 270, 360, 450, 540, 630, 720, 810, 900]
FIBRE_G = [0.9, 1.9, 2.8, 3.7, 4.7]
PROTEIN_G = [1.6, 3.2, 4.8, 6.4, 8.0]
FRUIT_SHARE = [40, 60, 80]
FRUIT_POINTS, FRUIT_POINTS_BEVERAGE = [0, 1, 2, 5], [0, 2, 4, 10]
LOWEST, HIGHEST = -15, 40

# Fixed values of the fruit, vegetable, legume and nut classes, in the order in which they are tried.
STARCHY = ("potato", "french fr", "frites", "hash brown", "tater", "cassava", "yam", "plantain", "tapioca", "starchy")
GOOD_OILS = ("olive oil", "rapeseed", "canola", "colza", "walnut oil")
NO_CLASS = ("soy sauce", "plant-based milk", "plant based milk", "juice drink", "juice cocktail", "-ade", "soda", "fruit drink", "tamari")
NUT_CATEGORY = ("nut and seed", "nuts and seeds")
LEGUME_CATEGORY = ("legume", "beans, peas")
FRUIT_CATEGORY = ("fruit", "apple", "banana", "berr", "citrus", "melon", "peach", "nectarine", "pear", "grape", "pineapple", "mango", "cherr", "plum", "apricot", "kiwi", "pomegran")
VEGETABLE_CATEGORY = ("vegetable", "tomato", "onion", "spinach", "lettuce", "carrot", "broccoli", "pepper", "cucumber", "mushroom", "cabbage", "squash", "greens", "green beans", "cauliflower", "celery", "asparagus", "eggplant", "zucchini", "beet", "dark-green", "red and orange", "okra", "artichoke", "kale", "brussels", "string bean")
NUTS = ("almond", "cashew", "walnut", "pecan", "pistachio", "hazelnut", "peanut", "macadamia", "pine nut", "brazil nut", "sesame", "sunflower seed", "pumpkin seed", "tahini", "nut butter", "chia", "flaxseed", "flax seed", "hemp seed", "poppy seed")
LEGUMES = ("bean", "lentil", "chickpea", "garbanzo", "edamame", "tofu", "tempeh", "soybean", "hummus", "split pea", "black-eyed", "pinto", "kidney bean", "cannellini", "mung")
FRUITS = ("apple", "banana", "orange", "lemon", "lime", "grape", "berry", "berries", "strawberr", "blueberr", "raspberr", "mango", "pineapple", "peach", "pear", "plum", "cherry", "melon", "watermelon", "kiwi", "apricot", "fig", "pomegran", "cranberr", "papaya", "guava", "passion fruit", "fruit", "avocado", "coconut", "raisin", "currant", "date")
VEGETABLES = ("tomato", "onion", "garlic", "ginger", "spinach", "lettuce", "carrot", "broccoli", "bell pepper", "jalapeno", "jalapeño", "chili pepper", "cucumber", "mushroom", "cabbage", "squash", "zucchini", "eggplant", "cauliflower", "celery", "asparagus", "beet", "kale", "okra", "artichoke", "brussels", "pumpkin", "leek", "shallot", "scallion", "green bean", "snap pea", "snow pea", "bok choy", "radish", "turnip", "parsnip", "fennel", "watercress", "arugula", "chard", "collard", "corn", "sweetcorn", "pea,", "peas,")

# Fixed values of the seven diet groups, in the order in which they are tried.
MEAT_ALTERNATIVES = ("meat-alternative", "meat alternative", "meatless", "plant-based", "plant based", "vegetarian", "vegan", "meat substitute", "imitation", "tofu", "tempeh", "seitan", "soy-based", "veggie burger", "beyond ", "impossible ")
PROCESSED_CATEGORY = ("bacon", "sausage", "frankfurter", "cold cuts and cured", "luncheon meat", "cured meat", "deli and cured")
PROCESSED = ("bacon", "ham,", " ham", "sausage", "salami", "pepperoni", "chorizo", "prosciutto", "hot dog", "frankfurter", "bologna", "pastrami", "corned beef", "luncheon", "bratwurst", "kielbasa", "deli ", "cured", "smoked sausage", "pancetta", "mortadella", "capicola", "soppressata", "andouille", "linguica", "spam", "pepperette", "jerky", "summer sausage", "liverwurst", "blood sausage", "chorizo", "nduja", "guanciale")
RED_CATEGORY = ("beef products", "beef, excludes ground", "ground beef", "pork", "pork products", "lamb, veal", "lamb, goat", "liver and organ")
RED = ("beef", "pork", "lamb", "veal", "goat meat", "venison", "bison", "mutton", "ground beef", "steak", "tenderloin", "sirloin", "ribeye", "brisket", "oxtail", "tripe", "liver", "kidney")
NOT_RED = ("chicken", "turkey", "duck", "poultry", "fish", "salmon", "tuna", "shrimp", "egg", "broth", "bouillon", "stock,", "gravy")
WHOLE_GRAINS = ("whole wheat", "whole-wheat", "whole grain", "whole-grain", "wholegrain", "wholemeal", "brown rice", "wild rice", "oatmeal", "rolled oats", "steel-cut", "oat bran", "oats", "barley", "quinoa", "bulgur", "buckwheat", "rye ", "rye,", "rye bread", "millet", "farro", "spelt", "sorghum", "freekeh", "amaranth", "teff", "whole rye", "whole oat", "popcorn", "cracked wheat")


def grid_points(value: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds that ``value`` exceeds."""
    return reduce(lambda a, b: a + b, [F.coalesce((value > F.lit(float(t))).cast("int"), F.lit(0)) for t in thresholds])


def nutri_score(energy_kcal: Column, sugars_g: Column, saturated_g: Column, sodium_mg: Column, protein_g: Column, fibre_g: Column, fruit_share: Column, fat_g: Column, kind: Column, water: Column) -> Column:
    """Profile of a food by its contents in 100 g; ``kind`` is general, beverage, cheese or fat."""
    beverage = kind == "beverage"
    either = lambda drink, food: F.when(beverage, drink).otherwise(food)
    energy = F.coalesce(energy_kcal, F.lit(0.0)) * KJ_PER_KCAL
    energy_points = either(grid_points(energy, ENERGY_KJ_BEVERAGE), grid_points(energy, ENERGY_KJ))
    sugar_points = either(grid_points(sugars_g, SUGAR_G_BEVERAGE), grid_points(sugars_g, SUGAR_G))
    share = F.when(fat_g > 0, saturated_g / fat_g * 100).otherwise(0.0)
    saturated_points = F.when(kind == "fat", grid_points(share, SATURATED_SHARE)).otherwise(grid_points(saturated_g, SATURATED_G))
    sodium_points = grid_points(sodium_mg, SODIUM_MG)
    fruit = grid_points(fruit_share, FRUIT_SHARE) + 1
    fruit_points = either(F.element_at(F.array(*map(F.lit, FRUIT_POINTS_BEVERAGE)), fruit), F.element_at(F.array(*map(F.lit, FRUIT_POINTS)), fruit))
    fibre_points, protein_points = grid_points(fibre_g, FIBRE_G), grid_points(protein_g, PROTEIN_G)
    negative = energy_points + sugar_points + saturated_points + sodium_points
    counted = ~((negative >= 11) & (fruit_points < 5) & (kind != "cheese"))
    positive = fruit_points + fibre_points + F.when(counted, protein_points).otherwise(0)
    score = negative - positive
    general = F.when(score <= -1, "A").when(score <= 2, "B").when(score <= 10, "C").when(score <= 18, "D").otherwise("E")
    drink = F.when(water, "A").when(score <= 1, "B").when(score <= 5, "C").when(score <= 9, "D").otherwise("E")
    grade = either(drink, general)
    scaled = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - LOWEST) / F.lit(float(HIGHEST - LOWEST)))) * 100, 2)
    return F.struct(
        energy_points.alias("energy_points"), sugar_points.alias("sugar_points"), saturated_points.alias("saturated_points"), sodium_points.alias("sodium_points"), negative.alias("negative_points"),
        fruit_points.alias("fruit_points"), fibre_points.alias("fibre_points"), protein_points.alias("protein_points"), counted.alias("protein_counted"), positive.alias("positive_points"),
        score.alias("score"), grade.alias("grade"), (F.ascii(grade) - 64).alias("score_1to5"), scaled.alias("score_0to100"),
    )


# Names of drinks, words of solid food that overrule them, and names of water.
DRINKS = (
    "smoothie", "smoothies", "milkshake", "milkshakes", "milk shake", "shake", "shakes", "latte", "lattes", "cappuccino", "espresso", "macchiato", "frappuccino", "frappe", "frappes", "lemonade",
    "soda", "cola", "juice", "boba", "horchata", "milk tea", "iced coffee", "iced tea", "hot chocolate", "hot cocoa", "bubble tea", "agua fresca", "protein shake", "chai latte", "matcha latte",
)
SOLIDS = (
    "cake", "cheesecake", "bread", "muffin", "cookie", "pie", "tart", "donut", "doughnut", "sandwich", "brownie", "pancake", "waffle", "soup", "ice cream", "popsicle", "sorbet", "parfait", "bowl",
    "oatmeal", "porridge", "pudding", "bake", "glazed", "ribs", "wing", "rice", "noodle", "salad", "bar", "pizza", "taco", "burrito", "chicken", "beef", "pork", "steak", "shrimp", "fish", "burger",
    "wrap", "platter", "plate", "sauce", "glaze",
)
WATERS = ("sparkling water", "mineral water", "still water", "bottled water")


def food_kind(name: Column, dominant: Column, share: Column) -> Column:
    """kind and water: water by name, drinks by whole words unless a solid is named too, else cheese or fat where the
    dominant food is of that class and makes up more than half."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    water = contains_any(lower, WATERS) | (F.trim(lower) == "water")
    drink = lower.rlike("\\b(" + "|".join(DRINKS) + ")\\b") & ~contains_any(lower, SOLIDS)
    kind = F.when(water | drink, "beverage").when((share > 0.5) & dominant.isin("cheese", "fat"), dominant).otherwise("general")
    return F.struct(kind.alias("kind"), water.alias("water"))


def fruit_class(description: Column, category: Column) -> Column:
    """fruit, vegetable, legume, nut, oil or none; exclusions come first."""
    d, c = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    excluded = contains_any(d, STARCHY) | contains_any(c, ("starchy", "white potato")) | contains_any(d, NO_CLASS) | contains_any(c, ("spices and herbs", "plant-based milk", "plant based milk")) | d.startswith("spices,")
    return (
        F.when(excluded, "none")
        .when(d.contains("oil") & ~d.contains("boil"), F.when(contains_any(d, GOOD_OILS), "oil").otherwise("none"))
        .when(contains_any(c, NUT_CATEGORY) | contains_any(d, NUTS), "nut")
        .when(contains_any(c, LEGUME_CATEGORY) | contains_any(d, LEGUMES), "legume")
        .when(contains_any(c, FRUIT_CATEGORY) | contains_any(d, FRUITS), "fruit")
        .when(contains_any(c, VEGETABLE_CATEGORY) | contains_any(d, VEGETABLES), "vegetable")
        .otherwise("none")
    )


def diet_group(description: Column, category: Column) -> Column:
    """One of seven diet groups, or other."""
    d, c = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    fruit = fruit_class(description, category)
    shared = F.when(fruit == "fruit", "fruits").when(fruit == "vegetable", "vegetables").when(fruit == "legume", "legumes").when(fruit == "nut", "nuts_seeds").otherwise("other")
    return (
        F.when(contains_any(d, MEAT_ALTERNATIVES), F.when(contains_any(d, ("soy", "tofu", "tempeh", "bean", "lentil", "pea protein")), "legumes").otherwise("other"))
        .when(contains_any(c, PROCESSED_CATEGORY) | contains_any(d, PROCESSED), "processed_meat")
        .when(~contains_any(d, NOT_RED) & (contains_any(c, RED_CATEGORY) | contains_any(d, RED)), "red_meat")
        .when(contains_any(d, WHOLE_GRAINS) & ~d.contains("goat"), "whole_grains")
        .when(d.contains("rice") & (d.contains("brown") | d.contains("wild")), "whole_grains")
        .otherwise(shared)
    )


def sources_named(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Keys of the databases that a provenance text names, in the order of the patterns."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(k)) for p, k in patterns]))


def pedigree(sources: Column, confidence: Column, method: Column, n_matches: Column, completeness: dict[str, int], temporal: dict[str, int], geographic: dict[str, int]) -> Column:
    """Five marks from 1 (best) to 5, their mean and its letter."""
    n, none = F.size(sources), F.size(sources) == 0
    guessed = F.lower(method).contains("llm")
    least = lambda marks: F.array_min(F.transform(sources, lambda s: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in marks.items() for x in kv]), s), F.lit(4))))
    reliability = F.when(n >= 3, 1).when(n == 2, 2).when(n == 1, 3).when(guessed | F.lower(method).contains("reasoning"), 4).otherwise(5)
    complete = F.when(none, F.when(guessed, 5).otherwise(4)).otherwise(least(completeness))
    time = F.when(none, F.when(guessed, 4).otherwise(5)).otherwise(least(temporal))
    place = F.when(none, 5).otherwise(least(geographic))
    technology = F.when((confidence == "high") & (n_matches >= 3), 1).when(confidence == "high", 2).when(confidence == "medium", 3).when(guessed, 4).otherwise(5)
    mean = (reliability + complete + time + place + technology) / 5
    return F.struct(reliability.alias("reliability"), complete.alias("completeness"), time.alias("temporal"), place.alias("geographic"), technology.alias("technological"), mean.alias("average"), letter(mean).alias("grade"))


def letter(score: Column) -> Column:
    return F.when(score <= 1.5, "A").when(score <= 2.5, "B").when(score <= 3.5, "C").when(score <= 4.5, "D").otherwise("F")
