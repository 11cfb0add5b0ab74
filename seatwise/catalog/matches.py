"""Matching, ranking and the re-queries of ranked results."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from seatwise import fixtures as fx
from seatwise.catalog.common import history_text, recs
from seatwise.catalog.registry import CTES, query
from seatwise.dims import values as V
from seatwise.operators import matching as M, results, views
from seatwise.plans.recommend import ready_seats, recommend as recommended, seat_table
from seatwise.session import written

_ID = "profile_id, position"
_SEAT = "institute, branch, quota, gender_pool, seat_type"


_PAIRS = """SELECT profile_id, category, count(*) AS n, CAST(sum(closing_rank) AS BIGINT) AS closing,
    CAST(sum(rank * (closing_rank % 1009)) AS BIGINT) AS mixed FROM matches GROUP BY ALL"""


def _pairs(spark, sf, **options):
    pairs = M.match_programs(fx.profiles(spark, sf), fx.seats(spark, sf), **options)
    category = F.get(F.array(*map(F.lit, V.CATEGORIES)), "category_no")
    return pairs.groupBy("profile_id", category.alias("category")).agg(
        F.count("*").alias("n"),
        F.sum("closing_rank").cast("bigint").alias("closing"),
        F.sum(F.col("rank") * (F.col("closing_rank") % 1009)).cast("bigint").alias("mixed"),
    )


@query("match_programs", _PAIRS)
def match_programs(spark, sf):
    return _pairs(spark, sf)


@query("match_programs_split", _PAIRS)
def match_programs_split(spark, sf):
    """The same with small blocks, so that every key is cut."""
    return _pairs(spark, sf, block=50)


@query(
    "rank_recommendations",
    f"SELECT {_ID}, category, interest_score, closing_rank, {_SEAT} FROM recs",
)
def rank_recommendations(spark, sf):
    return recs(spark, sf).select(
        *_ID.split(", "), "category", "interest_score", "closing_rank", *_SEAT.split(", ")
    )


@query(
    "rank_all_matches",
    f"""SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY
            CASE category WHEN 'Target' THEN 0 WHEN 'Reach' THEN 1 ELSE 2 END,
            interest_score DESC, closing_rank, institute, branch, branch_full, quota,
            gender_pool, seat_type, opening_rank) AS position,
        category, interest_score, closing_rank, {_SEAT} FROM matches""",
)
def rank_all_matches(spark, sf):
    """All matches of each profile, not only the first ``max_results``."""
    return M.rank_all_matches(fx.profiles(spark, sf), fx.seats(spark, sf)).select(
        *_ID.split(", "), "category", "interest_score", "closing_rank", *_SEAT.split(", ")
    )


_TOP = """SELECT profile_id, position, category, interest_score, closing_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY
            CASE category WHEN 'Target' THEN 0 WHEN 'Reach' THEN 1 ELSE 2 END,
            interest_score DESC, closing_rank, institute, branch, branch_full, quota,
            gender_pool, seat_type, opening_rank) AS position FROM choosy_matches)
    WHERE position <= 1 + profile_id % 30"""


def _top(spark, sf, **options):
    limit = (1 + F.col("profile_id") % 30).cast("int")
    people = fx.profiles(spark, sf, preferences=True).withColumn("max_results", limit)
    return M.top_matches(people, fx.seats(spark, sf), **options).select(
        "profile_id", "position", "category", "interest_score", "closing_rank"
    )


@query("top_n", _TOP)
def top_n(spark, sf):
    return _top(spark, sf)


@query("top_n_split", _TOP)
def top_n_split(spark, sf):
    """The same with small blocks, so that every key is cut."""
    return _top(spark, sf, block=50)


_SHORT = "profile_id, position, institute, branch, seat_type, category, interest_score, total"


@query("recommend_any_seat", f"SELECT {_SHORT} FROM any_recs")
def recommend_any_seat(spark, sf):
    """Profiles without a seat category see the seats of all."""
    people = fx.profiles(spark, sf).withColumn("seat_category", F.lit(""))
    return recommended(people, fx.seats(spark, sf), texts=False).select(*_SHORT.split(", "))


@query("recommend_basic", f"SELECT {_SHORT} FROM any_recs")
def recommend_basic(spark, sf):
    """Locked to the basic dataset: no seat filter, whatever the profile asks for."""
    seats = ready_seats(seat_table(fx.programs(spark, sf), "basic", None, fx.YEAR))
    found = recommended(fx.profiles(spark, sf), seats, texts=False, allow_toggle=False)
    return found.select(*_SHORT.split(", "))


@query(
    "recommend",
    f"""SELECT {_ID}, {_SEAT}, institute_type, institute_state, exam, branch_full, degree,
        opening_rank, closing_rank, category, interest_score, matched_interest,
        home_state_advantage, female_seat_advantage, confidence, region, is_metro, history,
        admission_probability, total FROM choosy_recs""",
)
def recommend(spark, sf):
    return (
        recs(spark, sf, preferences=True)
        .withColumn("history", history_text())
        .select(
            *_ID.split(", "), *_SEAT.split(", "), "institute_type", "institute_state", "exam",
            "branch_full", "degree", "opening_rank", "closing_rank", "category", "interest_score",
            "matched_interest", "home_state_advantage", "female_seat_advantage", "confidence",
            "region", "is_metro", "history", "admission_probability", "total",
        )
    )


@query("type_filter", f"SELECT {_ID}, institute FROM recs WHERE institute_type = 'NIT'")
def type_filter(spark, sf):
    return views.type_filter(recs(spark, sf), "NIT").select(*_ID.split(", "), "institute")


@query(
    "region_filter",
    f"""SELECT {_ID}, institute, 'south' AS asked FROM recs WHERE region = 'south'
    UNION ALL SELECT {_ID}, institute, 'metro' FROM recs WHERE is_metro""",
)
def region_filter(spark, sf):
    found = recs(spark, sf)
    return functools.reduce(DataFrame.unionByName, [
        views.region_filter(found, region).select(
            *_ID.split(", "), "institute", F.lit(region).alias("asked")
        )
        for region in ("south", "metro")
    ])


@query(
    "text_search",
    f"""SELECT n.needle, {_ID}, branch FROM recs JOIN (VALUES ('econom'), ('#000000001'), ('pradesh'), ('4 years, b'))
        n(needle) ON contains(lower(institute), n.needle) OR contains(lower(branch), n.needle)
        OR contains(lower(branch_full), n.needle) OR contains(lower(institute_state), n.needle)""",
)
def text_search(spark, sf):
    """Texts that only the branch, the institute, the state and the full program name have."""
    rows = written(recs(spark, sf))
    found = [
        views.text_search(rows, needle).select(
            F.lit(needle.strip().lower()).alias("needle"), *_ID.split(", "), "branch"
        )
        for needle in (" ECONOM", "#000000001", "Pradesh ", "4 Years, B")
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


_PLACES = {
    "probability": "coalesce(admission_probability, 0) DESC",
    "rank": "closing_rank",
    "college": "institute",
}


@query(
    "view_sort",
    f"SELECT {_ID}, " + ", ".join(
        f"row_number() OVER (PARTITION BY profile_id, category ORDER BY {order}, position) "
        f"AS by_{key}" for key, order in _PLACES.items()
    ) + " FROM recs",
)
def view_sort(spark, sf):
    df = recs(spark, sf)
    for key in _PLACES:
        df = views.view_sort(df, key).withColumnRenamed("place", f"by_{key}")
    return df.select(*_ID.split(", "), *[f"by_{key}" for key in _PLACES])


@query(
    "sections",
    """SELECT profile_id, category, CASE category WHEN 'Target' THEN 0 WHEN 'Reach' THEN 1
        ELSE 2 END AS section_no, count(*) AS n FROM recs GROUP BY ALL""",
)
def sections(spark, sf):
    return views.sections(recs(spark, sf)).select("profile_id", "category", "section_no", "n")


@query(
    "college_groups",
    """SELECT *, row_number() OVER (PARTITION BY profile_id, category
            ORDER BY best DESC, first_position) AS place
    FROM (SELECT profile_id, category, institute, count(*) AS n,
            max(coalesce(admission_probability, 0)) AS best, min(closing_rank) AS closing_rank,
            min(position) AS first_position,
            string_agg(branch, '|' ORDER BY admission_probability DESC, position) AS branches
        FROM recs GROUP BY ALL)""",
)
def college_groups(spark, sf):
    groups = views.college_groups(recs(spark, sf))
    return groups.select(
        "profile_id", "category", "institute", "n",
        F.col("admission_probability").alias("best"),
        "closing_rank", "first_position",
        F.array_join("branches", "|").alias("branches"),
        "place",
    )


CTES["picks"] = """
    SELECT profile_id, string_agg(institute_type || ' ' || branch, ', ' ORDER BY position) AS picks
    FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY position) AS pick FROM
            (SELECT *, bool_or(category = 'Target') OVER (PARTITION BY profile_id) AS any_target
             FROM recs)
        WHERE category = 'Target' OR NOT any_target)
    WHERE pick <= 3 GROUP BY profile_id"""


@query("top_picks", "SELECT profile_id, picks FROM picks")
def top_picks(spark, sf):
    return views.top_picks(recs(spark, sf)).select(
        "profile_id", F.array_join("picks", ", ").alias("picks")
    )


@query(
    "ruler_positions",
    f"""SELECT {_ID}, (row_number() OVER (PARTITION BY profile_id, exam
            ORDER BY closing_rank, position) - 1) % 4 AS lane,
        round(least(greatest(log10(least(greatest(closing_rank, 1), 1000000)) / 6.0 * 100.0, 0.5),
            99.5), 2) AS axis FROM recs""",
)
def ruler_positions(spark, sf):
    return views.ruler_positions(recs(spark, sf)).select(
        *_ID.split(", "), "lane", F.round("axis", 2).alias("axis")
    )


_SPAN = "CAST(greatest(closing_rank - opening_rank, 1) AS DOUBLE)"
_START = f"(opening_rank - {_SPAN} * 0.45)"
_WIDTH = f"((closing_rank + {_SPAN} * 0.45) - {_START})"


@query(
    "rank_bar",
    f"""SELECT {_ID}, round((opening_rank - {_START}) / {_WIDTH} * 100.0, 1) AS window_left,
        round(100.0 - (closing_rank - {_START}) / {_WIDTH} * 100.0, 1) AS window_right,
        round(least(greatest((rank - {_START}) / {_WIDTH} * 100.0, 3.0), 97.0), 1) AS marker,
        CASE WHEN category = 'Safe' THEN 'safe' WHEN category = 'Reach' THEN 'reach'
            WHEN floor((rank - opening_rank) / {_SPAN} * 100.0 + 0.5) <= 55 THEN 'comfort'
            ELSE 'edge' END AS verdict,
        CASE WHEN category = 'Reach' THEN greatest(1,
            CAST(floor((rank - closing_rank) / closing_rank * 100.0 + 0.5) AS BIGINT)) END AS past
    FROM recs""",
)
def rank_bar(spark, sf):
    return views.rank_bar(recs(spark, sf)).select(
        *_ID.split(", "), "window_left", "window_right", "marker", "verdict", "past"
    )


@query(
    "history_timeline",
    f"""SELECT profile_id, position, CAST(split_part(point, ' -> ', 1) AS INT) AS year,
        CAST(split_part(point, ' -> ', 2) AS BIGINT) AS closing_rank,
        split_part(point, ' -> ', 1) = '{fx.YEAR}' AS is_current
    FROM (SELECT profile_id, position, unnest(string_split(trim(history, '{{}}'), ', ')) AS point
        FROM recs WHERE years > 1)""",
)
def history_timeline(spark, sf):
    return views.history_timeline(recs(spark, sf), fx.YEAR)


@query(
    "empty_flags",
    """SELECT p.profile_id, count(r.profile_id) = 0 AS no_results,
        count(r.profile_id) > 0 AND count(*) FILTER (r.institute_type = 'IIT'
            AND contains(lower(r.branch), 'economics')) = 0 AS all_filtered
    FROM profiles p LEFT JOIN recs r USING (profile_id) GROUP BY p.profile_id""",
)
def empty_flags(spark, sf):
    people = fx.profiles(spark, sf)
    found = written(recs(spark, sf))
    return views.empty_flags(people, found, views.visible(found, "IIT", "all", "Economics"))


_COUNTS = (
    "total, shown, n_target, n_reach, n_safe, n_iit, n_nit, n_iiit, n_gfti"
)


@query("result_counts", f"SELECT profile_id, {_COUNTS} FROM counted")
def result_counts(spark, sf):
    return results.result_counts(fx.profiles(spark, sf), recs(spark, sf)).select(
        "profile_id", *_COUNTS.split(", ")
    )
