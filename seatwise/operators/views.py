"""Re-queries of truncated recommendations: filters, sorts, groups, positions.

Every group here is one profile's recommendations, at most ``MAX_RESULTS_CAP`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.dims import values as V
from seatwise.functions.classify import category_order
from seatwise.functions.text import half_up

_MAX_AXIS_RANK = 1_000_000
_LANES = 4


def type_filter(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("institute_type") == kind) if kind else df


def region_filter(df: DataFrame, region: str) -> DataFrame:
    if not region or region == "all":
        return df
    return df.where("is_metro") if region == "metro" else df.where(F.col("region") == region)


def text_search(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose institute, branch, full program name or state contains the text."""
    low = needle.strip().lower()
    if not low:
        return df
    fields = ["institute", "branch", "branch_full", "institute_state"]
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.lower(name).contains(low)
    return df.where(hit)


def visible(df: DataFrame, kind: str = "", region: str = "all", needle: str = "") -> DataFrame:
    return text_search(region_filter(type_filter(df, kind), region), needle)


def _sort_keys(key: str, name: str = "institute") -> list[Column]:
    if key == "probability":
        return [F.desc(F.coalesce("admission_probability", F.lit(0.0)))]
    if key == "rank":
        return [F.asc_nulls_last("closing_rank")]
    if key == "college":
        return [F.asc(F.collate(F.col(name), "UNICODE"))]
    return []


def view_sort(recommendations: DataFrame, key: str = "probability") -> DataFrame:
    """Place of each row within its category: ``category``, ``probability``, ``rank``, ``college``.

    Equal rows keep the result order.
    """
    order = [*_sort_keys(key), F.asc("position")]
    place = F.row_number().over(Window.partitionBy("profile_id", "category").orderBy(*order))
    return recommendations.withColumn("place", place)


def sections(recommendations: DataFrame) -> DataFrame:
    """Categories that have rows, in display order, with their counts."""
    return (
        recommendations.groupBy("profile_id", "category")
        .agg(F.count("*").alias("n"))
        .withColumn("section_no", category_order(F.col("category")))
    )


def college_groups(recommendations: DataFrame, key: str = "probability") -> DataFrame:
    """One row per (profile, category, institute) with its place and its branches in order."""
    inner = [*_sort_keys(key, "branch"), F.asc("position")]
    group = ["profile_id", "category", "institute"]
    numbered = recommendations.withColumn(
        "_inner", F.row_number().over(Window.partitionBy(*group).orderBy(*inner))
    )
    colleges = numbered.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.max(F.coalesce("admission_probability", F.lit(0.0))).alias("admission_probability"),
        F.min("closing_rank").alias("closing_rank"),
        F.min("position").alias("first_position"),
        F.array_sort(F.collect_list(F.struct("_inner", "branch"))).alias("_rows"),
    )
    outer = [*_sort_keys(key), F.asc("first_position")]
    return colleges.select(
        *group,
        "n",
        "admission_probability",
        "closing_rank",
        "first_position",
        F.transform("_rows", lambda r: r["branch"]).alias("branches"),
        F.row_number()
        .over(Window.partitionBy("profile_id", "category").orderBy(*outer))
        .alias("place"),
    )


def top_picks(recommendations: DataFrame, limit: int = 3) -> DataFrame:
    """The first Targets, or the first rows if there is no Target, as ``type branch`` texts."""
    per_profile = Window.partitionBy("profile_id")
    is_target = (F.col("category") == "Target").cast("int")
    pool = recommendations.withColumn("_targets", F.max(is_target).over(per_profile)).where(
        (F.col("_targets") == 0) | (F.col("category") == "Target")
    )
    first = pool.withColumn(
        "_pick", F.row_number().over(per_profile.orderBy("position"))
    ).where(F.col("_pick") <= limit)
    label = F.concat_ws(" ", "institute_type", "branch")
    return first.groupBy("profile_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pick", label.alias("label")))),
            lambda r: r["label"],
        ).alias("picks")
    )


def axis_position(rank: Column) -> Column:
    """Percentage along a logarithmic axis from rank 1 to 10 lakh, kept inside the track."""
    inside = F.least(F.greatest(rank, F.lit(1)), F.lit(_MAX_AXIS_RANK))
    share = F.log10(inside) / F.lit(6.0) * F.lit(100.0)
    return F.least(F.greatest(share, F.lit(0.5)), F.lit(99.5))


def ruler_positions(recommendations: DataFrame) -> DataFrame:
    """Dot position and jitter lane of each row on the axis of its exam."""
    order = Window.partitionBy("profile_id", "exam").orderBy("closing_rank", "position")
    return recommendations.withColumns(
        {
            "lane": (F.row_number().over(order) - 1) % _LANES,
            "axis": axis_position(F.col("closing_rank")),
        }
    )


def rank_bar(df: DataFrame) -> DataFrame:
    """Window and candidate marker as percentages of the bar, and the verdict."""
    opening, closing, rank = F.col("opening_rank"), F.col("closing_rank"), F.col("rank")
    span = F.greatest(closing - opening, F.lit(1)).cast("double")
    start = opening - span * F.lit(0.45)
    width = (closing + span * F.lit(0.45)) - start

    def place(c: Column) -> Column:
        return (c - start) / width * F.lit(100.0)

    through = half_up((rank - opening) / span * F.lit(100.0))
    past = F.greatest(F.lit(1), half_up((rank - closing) / closing * F.lit(100.0)))
    return df.withColumns(
        {
            "window_left": F.round(place(opening), 1),
            "window_right": F.round(F.lit(100.0) - place(closing), 1),
            "marker": F.round(F.least(F.greatest(place(rank), F.lit(3.0)), F.lit(97.0)), 1),
            "verdict": F.when(F.col("category") == "Safe", "safe")
            .when(F.col("category") == "Reach", "reach")
            .when(through <= 55, "comfort")
            .otherwise("edge"),
            "past": F.when(F.col("category") == "Reach", past),
        }
    )


def history_timeline(recommendations: DataFrame, year: int = V.DEFAULT_YEAR) -> DataFrame:
    """Long rows of the histories that have more than one year."""
    return (
        recommendations.where(F.size("history") > 1)
        .select("profile_id", "position", F.explode("history").alias("year", "closing_rank"))
        .withColumn("is_current", F.col("year") == year)
    )


def empty_flags(profiles: DataFrame, recommendations: DataFrame, shown: DataFrame) -> DataFrame:
    """Whether a profile has no results at all, or only none left after filtering."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("profile_id").agg(F.count("*").alias(name))

    both = (
        profiles.select("profile_id")
        .join(counted(recommendations, "n_results"), "profile_id", "left")
        .join(counted(shown, "n_visible"), "profile_id", "left")
        .fillna(0)
    )
    return both.select(
        "profile_id",
        (F.col("n_results") == 0).alias("no_results"),
        ((F.col("n_results") > 0) & (F.col("n_visible") == 0)).alias("all_filtered"),
    )
