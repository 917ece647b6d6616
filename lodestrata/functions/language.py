"""Column expressions on labels, captions and answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which labels make "on" and "in" plausible (fixed values).
MOVABLE = ("book", "cup", "bottle", "laptop", "phone", "mouse", "keyboard", "plant", "vase", "bowl", "plate", "remote", "lamp")
SURFACES = ("table", "desk", "floor", "shelf", "counter", "nightstand", "dresser", "cabinet", "chair", "stool", "bed", "carpet", "rug")
CONTAINERS = ("box", "drawer", "cabinet", "shelf", "closet", "bag", "basket", "bin", "container", "cupboard")
CONTAINED = ("book", "clothing", "item", "object", "thing")


def says_any(label: Column, words: tuple[str, ...], whole_words: bool = False) -> Column:
    """Whether a label contains one of the words, as a substring or as a word of its own."""
    low = F.lower(F.trim(label))
    if whole_words:
        return F.arrays_overlap(F.split(low, r"(?U)\s+"), F.array(*[F.lit(w) for w in words]))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def plausible_on(a: Column, b: Column, whole_words: bool = False) -> Column:
    return says_any(a, MOVABLE, whole_words) & says_any(b, SURFACES, whole_words)


def plausible_in(a: Column, b: Column, whole_words: bool = False) -> Column:
    return says_any(b, CONTAINERS, whole_words) & (says_any(a, CONTAINED, whole_words) | (F.lower(F.trim(a)) != F.lower(F.trim(b))))


def relation_of(name: Column) -> Column:
    """A known relation type by its name, ``under`` as below; others and null are none."""
    low = F.lower(F.trim(name))
    known = ("on", "in", "near", "above", "below", "left_of", "right_of", "front_of", "behind")
    return F.when(low == "under", "below").when(low.isin(*known), low).otherwise("none")


def parsed_answer(answer: Column) -> Column:
    """The relation that a free answer names, by its words; the first rule that holds counts."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    words = F.filter(F.split(low, r"[^\p{L}]+"), lambda w: w != "")

    def has(*options: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(o) for o in options]))

    return (
        F.when(F.contains(low, F.lit("on top of")) | (F.get(words, F.lit(0)) == "on"), "on")
        .when(has("under"), "below")
        .when(has("in", "inside"), "in")
        .when(has("near", "beside") | F.contains(low, F.lit("next to")), "near")
        .when(has("above"), "above")
        .when(has("below"), "below")
        .when(has("left"), "left_of")
        .when(has("right"), "right_of")
        .when(has("front"), "front_of")
        .when(has("behind"), "behind")
        .otherwise("none")
    )


def answer_confidence(relation: Column) -> Column:
    return F.when(relation == "none", 0.5).otherwise(0.85)


def first_words(text: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, n), " ")
