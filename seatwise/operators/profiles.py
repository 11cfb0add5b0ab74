"""Candidate profiles: defaults, canonical values, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.dims import tables, values as V
from seatwise.functions.text import trimmed

DEFAULTS = {
    "data_mode": "basic",
    "seat_category": V.DEFAULT_SEAT_CATEGORY,
    "brand_branch_ratio": V.DEFAULT_RATIO,
    "max_results": V.DEFAULT_MAX_RESULTS,
    "lang": "en",
}


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Fill what a profile leaves out."""
    columns = {
        c: F.coalesce(F.col(c), F.lit(d)) if c in profiles.columns else F.lit(d)
        for c, d in DEFAULTS.items()
    }
    prefs = F.array().cast("array<string>")
    if "branch_preferences" in profiles.columns:
        prefs = F.coalesce("branch_preferences", prefs)
    return profiles.withColumns({**columns, "branch_preferences": prefs})


def canonical_state(df: DataFrame, column: str = "home_state") -> DataFrame:
    """The listed spelling of a state typed in any case; other texts stay as typed."""
    dim = tables.states(df.sparkSession).select("state", "state_lower")
    return (
        df.withColumn("_key", F.lower(trimmed(F.col(column))))
        .join(dim, F.col("_key") == F.col("state_lower"), "left")
        .withColumn(column, F.coalesce("state", column))
        .drop("_key", "state", "state_lower")
    )


def rejection_reason():
    """Why a profile is invalid; null for a valid one."""

    def outside(name: str, allowed: list[str]):
        return ~F.coalesce(F.col(name).isin(allowed), F.lit(False))

    checks = [
        (F.col("adv_rank") < 1, "adv_rank below 1"),
        (F.col("mains_rank") < 1, "mains_rank below 1"),
        (F.col("adv_rank").isNull() & F.col("mains_rank").isNull(), "no rank"),
        (outside("gender", V.GENDERS), "gender"),
        (F.col("home_state").isNull(), "home_state"),
        (outside("goal", V.GOALS), "goal"),
        (outside("data_mode", V.DATA_MODES), "data_mode"),
        (~F.col("brand_branch_ratio").between(0.0, 1.0), "brand_branch_ratio"),
        (~F.col("max_results").between(1, V.MAX_RESULTS_CAP), "max_results"),
        (outside("lang", V.LANGUAGES), "lang"),
    ]
    return F.coalesce(*[F.when(bad, reason) for bad, reason in checks])


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid profiles with canonical states, and rejected ones with a ``reason``.

    All profiles of an id that occurs more than once are rejected.
    """
    ids = profiles.groupBy("profile_id").agg((F.count("*") > 1).alias("_again"))
    repeated = ids.where("_again").select(F.col("profile_id").alias("_id"), "_again")
    checked = with_defaults(profiles).join(repeated, F.col("profile_id") == F.col("_id"), "left")
    own = F.when(F.col("profile_id").isNull(), "profile_id").when(F.col("_again"), "profile_id repeated")
    checked = checked.withColumn("reason", F.coalesce(own, rejection_reason())).drop("_id", "_again")
    valid = checked.where("reason is null").drop("reason")
    return canonical_state(valid), checked.where("reason is not null")


def profile_ranks(profiles: DataFrame) -> DataFrame:
    """One row per profile and exam it has a rank for."""
    ranks = F.array(
        F.struct(F.lit("advanced").alias("exam"), F.col("adv_rank").alias("rank")),
        F.struct(F.lit("mains").alias("exam"), F.col("mains_rank").alias("rank")),
    )
    kept = [c for c in profiles.columns if c not in ("adv_rank", "mains_rank")]
    return profiles.select(*kept, F.inline(ranks)).where("rank is not null")


def preference_tag_sets(profiles: DataFrame) -> DataFrame:
    """Union of the tags of each profile's known preferences; empty means no filter.

    A profile has few preferences, so they are looked up within the row.
    """
    lookup = F.create_map(*[
        part
        for p, tags in V.PREFERENCE_TAGS.items()
        for part in (F.lit(p), F.array(*[F.lit(t) for t in tags]))
    ])
    known = F.filter(
        F.transform("branch_preferences", lambda p: F.try_element_at(lookup, p)),
        lambda tags: tags.isNotNull(),
    )
    return profiles.withColumn(
        "wanted_tags", F.array_sort(F.array_distinct(F.flatten(known)))
    )
