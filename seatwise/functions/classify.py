"""Derived attributes of institutes, programs and matches, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from seatwise.dims import values as V
from seatwise.functions.text import trimmed


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def institute_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(
            low.contains("indian institute of technology") & ~low.contains("information"), "IIT"
        )
        .when(low.contains("national institute of technology"), "NIT")
        .when(low.contains("information technology"), "IIIT")
        .otherwise("GFTI")
    )


def brand_score(name: Column, kind: Column) -> Column:
    score = {tier: F.lit(value) for tier, value in V.BRAND_SCORES.items()}
    return (
        F.when((kind == "IIT") & name.isin(V.OLD_IITS), score["top_iit"])
        .when(kind == "IIT", score["iit"])
        .when((kind == "NIT") & name.isin(V.TOP_NITS), score["top_nit"])
        .when(kind == "NIT", score["nit"])
        .when(kind == "IIIT", score["iiit"])
        .otherwise(score["gfti"])
    )


def brand_tier(kind: Column, score: Column) -> Column:
    return (
        F.when((kind == "IIT") & (score >= V.BRAND_SCORES["top_iit"]), "top_iit")
        .when(kind == "IIT", "iit")
        .when((kind == "NIT") & (score >= V.BRAND_SCORES["top_nit"]), "top_nit")
        .when(kind == "NIT", "nit")
        .when(kind == "IIIT", "iiit")
        .otherwise("gfti")
    )


def exam_of(kind: Column) -> Column:
    return F.when(kind == "IIT", "advanced").otherwise("mains")


def state_in_name(name: Column) -> Column:
    """The first state, in the fixed order, whose name occurs in the institute's name."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(s.lower()), s) for s in V.STATES])


def _tag_rules(program: Column) -> dict[str, Column]:
    low = F.lower(program)
    rules = {}
    for tag, (wanted, unwanted) in V.TAG_KEYWORDS.items():
        hit = _any(
            [low.contains(word) for word in wanted]
            + [F.startswith(trimmed(low), F.lit(p)) for p in V.TAG_PREFIXES.get(tag, [])]
        )
        rules[tag] = reduce(lambda c, word: c & ~low.contains(word), unwanted, hit)
    return rules


def branch_tags(program: Column) -> Column:
    """Sorted tags of a full program name.

    Only functions with generated code: higher-order functions such as ``filter`` would make the
    whole expression interpreted, which is many times slower.
    """
    rules = sorted(_tag_rules(program).items())
    tags = F.array_remove(F.array(*[F.when(c, tag).otherwise("") for tag, c in rules]), "")
    return F.coalesce(F.nullif(tags, F.array().cast("array<string>")), F.array(F.lit(V.DEFAULT_TAG)))


TAG_BITS = {tag: 1 << i for i, tag in enumerate([*V.TAG_KEYWORDS, V.DEFAULT_TAG])}


def tag_mask(tags: Column) -> Column:
    """Tags as a bit set, so that overlap is a single ``&`` per pair."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.when(F.array_contains(tags, tag), F.lit(bit)).otherwise(F.lit(0))
            for tag, bit in TAG_BITS.items()
        ],
    ).cast("int")


def preference_mask(preferences: Column) -> Column:
    """Bit set of the tags wanted by the known preferences; 0 means no filter."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.when(
                F.array_contains(preferences, p), F.lit(sum(TAG_BITS[t] for t in tags))
            ).otherwise(F.lit(0))
            for p, tags in V.PREFERENCE_TAGS.items()
        ],
    ).cast("int")


def region_of(state: Column) -> Column:
    region = F
    for name, members in V.REGIONS.items():
        region = region.when(state.isin(members), name)
    return region.otherwise(V.DEFAULT_REGION)


def is_metro(institute: Column, state: Column) -> Column:
    low = F.lower(institute)
    return _any([low.contains(city) for city in V.METRO_CITIES]) | (state == "Delhi")


def confidence_band(opening: Column, closing: Column) -> Column:
    spread = closing - opening
    return (
        F.when(spread < V.FRAGILE_BELOW_SPREAD, "fragile")
        .when(spread >= V.HIGH_FROM_SPREAD, "high")
        .otherwise("medium")
    )


def band_bounds(opening: Column, closing: Column) -> tuple[Column, Column]:
    """Lowest and highest rank for which a program is kept."""
    return opening * F.lit(1 - V.LOWER_MARGIN), closing * F.lit(1 + V.UPPER_MARGIN)


def in_band(rank: Column, opening: Column, closing: Column) -> Column:
    low, high = band_bounds(opening, closing)
    return (rank >= low) & (rank <= high)


def rank_category(rank: Column, opening: Column, closing: Column) -> Column:
    """Safe, Target or Reach; null outside the band."""
    return F.when(
        in_band(rank, opening, closing),
        F.when(rank <= opening, "Safe").when(rank <= closing, "Target").otherwise("Reach"),
    )


def category_order(category: Column) -> Column:
    order = F
    for i, name in enumerate(V.CATEGORIES):
        order = order.when(category == name, i)
    return order


def probability_band(probability: Column) -> Column:
    return F.when(
        probability.isNotNull(),
        F.when(probability >= 75, "high").when(probability >= 35, "medium").otherwise("low"),
    )


def college_location(institute: Column, state: Column) -> Column:
    parts = F.split(institute, ",", -1)
    place = F.when(F.size(parts) > 1, trimmed(F.try_element_at(parts, F.lit(2))))
    for prefix in (
        "Indian Institute of Technology",
        "Indian Institute of Information Technology",
    ):
        place = place.when(
            F.startswith(institute, F.lit(prefix)),
            trimmed(F.substring(institute, F.lit(len(prefix) + 1), F.length(institute))),
        )
    return place.otherwise(state)


def is_dual_degree(degree: Column) -> Column:
    return F.lower(degree).contains("dual")
