"""Profiles as query-string links, and logged links back as profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.dims import values as V
from seatwise.functions.text import trimmed

_LEADING_INTEGER = r"^([+-]?\d+)"
_LEADING_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _number_text(c: Column) -> Column:
    """1 rather than 1.0"""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def link_of(base: str) -> Column:
    """Link for a profile row; parts without a value are left out.

    Besides the profile columns it uses ``step``, ``region``, ``needle`` and ``type``.
    """
    some = lambda c: F.when(c != "", c)
    parts = {
        "step": F.col("step"),
        "m": F.col("mains_rank").cast("string"),
        "a": F.col("adv_rank").cast("string"),
        "g": some(F.col("gender")),
        "cat": F.coalesce(some(F.col("seat_category")), F.lit(V.DEFAULT_SEAT_CATEGORY)),
        "s": some(F.col("home_state")),
        "goal": F.col("goal"),
        "b": some(F.array_join("branch_preferences", ",")),
        "region": F.when(F.col("region") != "all", F.col("region")),
        "ratio": _number_text(F.col("brand_branch_ratio")),
        "q": some(F.col("needle")),
        "t": some(F.col("type")),
        "lang": F.col("lang"),
    }
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parts.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def profile_links(profiles: DataFrame, base: str) -> DataFrame:
    return profiles.select("profile_id", link_of(base).alias("url"))


def _leading(c: Column, pattern: str, kind: str) -> Column:
    """The number a text starts with, as browsers parse it."""
    return F.regexp_extract(trimmed(c), pattern, 1).try_cast(kind)


def _decoded(c: Column) -> Column:
    """Plus signs as spaces and valid escapes decoded; a percent sign of its own stays one."""
    alone = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(alone), F.replace(c, F.lit("+"), F.lit(" ")))


def linked_profiles(links: DataFrame) -> DataFrame:
    """Profiles restored from ``url``; links without parameters are dropped.

    Values outside their vocabulary fall back to the default.
    """
    before_fragment = F.substring_index("url", "#", 1)
    start = F.locate("?", before_fragment)
    query = F.when(start > 0, F.substring(before_fragment, start + 1, F.length(before_fragment)))
    asked = links.withColumn("_query", query).where(F.coalesce("_query", F.lit("")) != "")
    pairs = F.split("_query", "&")

    def part(key: str) -> Column:
        """The first value of a key, decoded like a browser does it."""
        own = F.filter(pairs, lambda p: _decoded(F.substring_index(p, "=", 1)) == key)
        first = F.get(own, 0)
        at = F.locate("=", first)
        return _decoded(F.when(at > 0, F.substring(first, at + 1, F.length(first))).otherwise(F.when(first.isNotNull(), "")))

    raw = asked.withColumns({f"_{k}": part(k) for k in (
        "m", "a", "g", "cat", "s", "goal", "b", "region", "ratio", "q", "t", "lang"
    )}).drop("_query")

    def rank(key: str) -> Column:
        value = _leading(F.col(key), _LEADING_INTEGER, "bigint")
        return F.when(value > 0, value)

    def listed(key: str, allowed: list[str]) -> Column:
        return F.when(F.col(key).isin(allowed), F.col(key))

    wanted = F.transform(F.split(F.coalesce("_b", F.lit("")), ","), trimmed)
    return raw.select(
        *links.columns,
        rank("_m").alias("mains_rank"),
        rank("_a").alias("adv_rank"),
        # the request sends male for everything but female
        F.when(F.col("_g") == "female", "female").otherwise("male").alias("gender"),
        F.coalesce(
            listed("_cat", V.SEAT_CATEGORIES), F.lit(V.DEFAULT_SEAT_CATEGORY)
        ).alias("seat_category"),
        F.coalesce(listed("_s", V.STATES), F.lit("")).alias("home_state"),
        listed("_goal", V.GOALS).alias("goal"),
        F.filter(wanted, lambda p: p.isin(list(V.PREFERENCE_TAGS))).alias("branch_preferences"),
        F.when(F.coalesce("_region", F.lit("")) == "", "all")
        .otherwise(F.col("_region"))
        .alias("region"),
        F.coalesce(
            _leading(F.col("_ratio"), _LEADING_NUMBER, "double"), F.lit(V.DEFAULT_RATIO)
        ).alias("brand_branch_ratio"),
        F.lower(F.coalesce("_q", F.lit(""))).alias("needle"),
        F.coalesce("_t", F.lit("")).alias("type"),
        F.coalesce(listed("_lang", V.LINK_LANGUAGES), F.lit("en")).alias("lang"),
        F.lit(V.LINK_MAX_RESULTS).alias("max_results"),
    )
