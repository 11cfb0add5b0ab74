"""The program table: derived attributes, history and advantages of each seat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.dims import tables, values as V
from seatwise.functions import classify
from seatwise.functions.scoring import volatility
from seatwise.functions.text import (
    normalised_gender,
    program_branch,
    program_degree,
    trimmed,
)
from seatwise.operators.rounds import HISTORY_KEY

SEAT_STATE_UNKNOWN = "Unknown"


def with_institute_state(df: DataFrame) -> DataFrame:
    """Mapped state of the institute, else the first state in its name, else ``Unknown``."""
    dim = tables.institute_states(df.sparkSession)
    return (
        df.join(dim, "institute", "left")
        .withColumn(
            "institute_state",
            F.coalesce(
                "mapped_state",
                classify.state_in_name(F.col("institute")),
                F.lit(SEAT_STATE_UNKNOWN),
            ),
        )
        .drop("mapped_state")
    )


def build_programs(
    last_rounds: DataFrame, missing_quota: str = V.DEFAULT_QUOTA
) -> DataFrame:
    """One program per last-round row, with everything derived from its texts.

    Snapshot rows pass a ``missing_quota`` that is no known code, so that such a seat is open to
    all without counting as an all-India seat.
    """
    seats = last_rounds.select(
        trimmed(F.col("institute")).alias("institute"),
        trimmed(F.col("program")).alias("branch_full"),
        F.coalesce(trimmed(F.col("quota")), F.lit(missing_quota)).alias("quota"),
        F.coalesce(trimmed(F.col("seat_type")), F.lit(V.DEFAULT_SEAT_CATEGORY)).alias("seat_type"),
        normalised_gender(F.col("gender")).alias("gender_pool"),
        "opening_rank",
        "closing_rank",
    )
    kinds = with_institute_state(seats).withColumn(
        "institute_type", classify.institute_type(F.col("institute"))
    )
    return kinds.select(
        "institute",
        "institute_type",
        "institute_state",
        classify.exam_of(F.col("institute_type")).alias("exam"),
        program_branch(F.col("branch_full")).alias("branch"),
        "branch_full",
        program_degree(F.col("branch_full")).alias("degree"),
        "quota",
        "gender_pool",
        "seat_type",
        "opening_rank",
        "closing_rank",
        classify.brand_score(F.col("institute"), F.col("institute_type")).alias("brand_score"),
        classify.branch_tags(F.col("branch_full")).alias("tags"),
    )


def program_history(last_rounds: DataFrame) -> DataFrame:
    """Per seat: year -> closing rank in year order, number of years, population deviation.

    The input has one row per seat and year, so a group is as long as the years are many.
    """
    point = F.struct("year", "closing_rank")
    return last_rounds.groupBy(*HISTORY_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(point))).alias("history"),
        F.count("*").alias("years"),
        F.stddev_pop("closing_rank").alias("deviation"),
    )


def with_history(
    programs: DataFrame, history: DataFrame | None, year: int = V.DEFAULT_YEAR
) -> DataFrame:
    """History and volatility of each program; without a hit, its own closing rank only.

    Pass ``None`` for snapshot (basic) programs, which never look anything up.
    """
    own = F.create_map(F.lit(year), F.col("closing_rank"))
    if history is None:
        found = programs.withColumns(
            {"history": own, "years": F.lit(1), "deviation": F.lit(0.0)}
        )
    else:
        keyed = history.withColumnRenamed("program", "branch_full")
        keys = ["branch_full" if k == "program" else k for k in HISTORY_KEY]
        found = programs.join(keyed, keys, "left").withColumns(
            {"history": F.coalesce("history", own), "years": F.coalesce("years", F.lit(1))}
        )
    sigma = volatility(F.col("years"), F.col("deviation"), F.col("closing_rank"))
    return found.withColumn("sigma", sigma).drop("years", "deviation")


def home_state_advantage(programs: DataFrame, by_seat_type: bool = False) -> DataFrame:
    """Ranks a home-state seat saves against the other-state, else the all-India seat.

    Seat types are mixed unless ``by_seat_type`` is set.
    """
    keys = ["institute", "branch_full", "exam", "gender_pool"]
    keys += ["seat_type"] if by_seat_type else []

    def closing(quota: str):
        return F.max(F.when(F.col("quota") == quota, F.col("closing_rank")))

    return (
        programs.groupBy(*keys)
        .agg((F.coalesce(closing("OS"), closing("AI")) - closing("HS")).alias("advantage"))
        .where("advantage > 0")
    )


def female_seat_advantage(programs: DataFrame, by_seat_type: bool = False) -> DataFrame:
    """How many ranks later the female pool closes than the neutral pool."""
    keys = ["institute", "branch_full", "exam", "quota"]
    keys += ["seat_type"] if by_seat_type else []

    def closing(pool: str):
        return F.max(F.when(F.col("gender_pool") == pool, F.col("closing_rank")))

    return (
        programs.groupBy(*keys)
        .agg((closing("female") - closing("neutral")).alias("advantage"))
        .where("advantage > 0")
    )


def with_advantages(programs: DataFrame, by_seat_type: bool = False) -> DataFrame:
    """Both advantages on the program rows.

    Only female candidates ever see a female seat, so the female advantage may sit on the seat.
    """
    extra = ["seat_type"] if by_seat_type else []
    home = home_state_advantage(programs, by_seat_type).withColumnsRenamed(
        {"advantage": "home_state_advantage"}
    )
    female = female_seat_advantage(programs, by_seat_type).withColumnsRenamed(
        {"advantage": "female_seat_advantage"}
    )
    home = home.withColumn("quota", F.lit("HS"))
    female = female.withColumn("gender_pool", F.lit("female"))
    keys = ["institute", "branch_full", "exam", "quota", "gender_pool", *extra]
    return programs.join(home, keys, "left").join(female, keys, "left")
