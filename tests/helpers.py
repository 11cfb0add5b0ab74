"""Small tables for tests."""

from pyspark.sql import DataFrame, functions as F

from seatwise.functions import classify, eligibility
from seatwise.plans.recommend import ready_seats, seat_table

PROGRAM = {
    "institute": "Test Institute",
    "institute_type": "NIT",
    "institute_state": "Rajasthan",
    "exam": "mains",
    "branch": "CSE",
    "branch_full": "Computer Science and Engineering (4 Years, B.Tech)",
    "degree": "B.Tech",
    "quota": "AI",
    "gender_pool": "neutral",
    "seat_type": "OPEN",
    "opening_rank": 1000,
    "closing_rank": 2000,
    "brand_score": 0.7,
}
PROGRAM_SCHEMA = ", ".join(
    f"{c} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}"
    for c, v in PROGRAM.items()
)
PROFILE = {
    "profile_id": 1,
    "adv_rank": None,
    "mains_rank": 1500,
    "gender": "male",
    "home_state": "Rajasthan",
    "goal": "coding",
    "data_mode": "extended",
    "seat_category": "OPEN",
    "brand_branch_ratio": 0.5,
    "branch_preferences": [],
    "max_results": 60,
    "lang": "en",
}
PROFILE_SCHEMA = (
    "profile_id bigint, adv_rank bigint, mains_rank bigint, gender string, home_state string, "
    "goal string, data_mode string, seat_category string, brand_branch_ratio double, "
    "branch_preferences array<string>, max_results int, lang string"
)


def programs(spark, *changes):
    rows = [tuple({**PROGRAM, **c}.values()) for c in changes]
    df = spark.createDataFrame(rows, PROGRAM_SCHEMA)
    return df.withColumn("tags", classify.branch_tags(F.col("branch_full")))


def seats(spark, *changes, mode="extended"):
    return ready_seats(seat_table(programs(spark, *changes), mode, None))


def profiles(spark, *changes):
    return spark.createDataFrame(
        [tuple({**PROFILE, **c}.values()) for c in changes], PROFILE_SCHEMA
    )


def one(spark, column, **values):
    """The value of a column expression on a single row."""
    kinds = {int: "bigint", float: "double", str: "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema or "x bigint").select(column).first()[0]


def match_programs_unbinned(profiles: DataFrame, programs: DataFrame) -> DataFrame:
    """The pairs of ``match_programs`` from the literal predicates."""
    p, s = profiles.alias("p"), programs.alias("s")
    rank = eligibility.relevant_rank(F.col("s.exam"), F.col("p.adv_rank"), F.col("p.mains_rank"))
    seat = (
        (F.col("p.data_mode") == "basic")
        | (F.col("p.seat_category") == "")
        | (F.col("p.seat_category") == F.col("s.seat_type"))
    )
    quota = eligibility.passes_quota(
        F.col("s.institute_type"),
        F.col("s.quota"),
        F.col("s.institute_state"),
        F.col("p.home_state"),
    )
    wanted = classify.preference_mask(F.col("p.branch_preferences"))
    tags = (wanted == 0) | (wanted.bitwiseAND(F.col("s.tag_mask")) != 0)
    condition = (
        (F.col("p.data_mode") == F.col("s.data_mode"))
        & seat
        & eligibility.passes_gender(F.col("s.gender_pool"), F.col("p.gender"))
        & quota
        & tags
        & classify.in_band(rank, F.col("s.opening_rank"), F.col("s.closing_rank"))
    )
    category = classify.rank_category(rank, F.col("s.opening_rank"), F.col("s.closing_rank"))
    return p.join(s, condition).select(
        "p.profile_id", "s.program_id", "s.exam", rank.alias("rank"), category.alias("category")
    )
