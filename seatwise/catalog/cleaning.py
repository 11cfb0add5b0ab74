"""Sources and cleaning of raw text rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatwise import fixtures as fx
from seatwise.catalog.registry import CTES, numeric, pool, query, trimmed
from seatwise.dims.values import PROGRAM_PATTERN
from seatwise.functions import text as X
from seatwise.operators import cleaning as C
from seatwise.sources.cutoffs import effective_mode, materialise

_KEY = "line, l_linenumber, l_extendedprice"

CTES["typed"] = f"""
    SELECT * REPLACE (CAST(trunc({numeric('opening_rank')}) AS BIGINT) AS opening_rank,
        CAST(trunc({numeric('closing_rank')}) AS BIGINT) AS closing_rank,
        coalesce(CAST(trunc({numeric('year')}) AS INT), {fx.YEAR}) AS year)
    FROM raw WHERE institute IS NOT NULL AND program IS NOT NULL
        AND {numeric('opening_rank')} IS NOT NULL AND {numeric('closing_rank')} IS NOT NULL"""


@query(
    "coerce_numeric",
    f"SELECT {_KEY}, {numeric('opening_rank')} AS opening_rank, "
    f"{numeric('closing_rank')} AS closing_rank, {numeric('round')} AS round FROM raw",
)
def coerce_numeric(spark, sf):
    columns = ["opening_rank", "closing_rank", "round"]
    return C.coerce_numeric(fx.raw_cutoffs(spark, sf), columns).select(*_KEY.split(", "), *columns)


@query(
    "drop_incomplete",
    f"SELECT {_KEY}, institute, program, opening_rank, closing_rank, year FROM typed",
)
def drop_incomplete(spark, sf):
    return C.typed_cutoffs(fx.raw_cutoffs(spark, sf), fx.YEAR).select(
        *_KEY.split(", "), "institute", "program", "opening_rank", "closing_rank", "year"
    )


@query(
    "trim_strings",
    f"SELECT {_KEY}, {trimmed('institute')} AS institute, {trimmed('program')} AS program, "
    f"{trimmed('quota')} AS quota, {trimmed('seat_type')} AS seat_type, "
    f"{trimmed('gender')} AS gender FROM raw",
)
def trim_strings(spark, sf):
    return C.trim_strings(fx.raw_cutoffs(spark, sf)).select(
        *_KEY.split(", "), "institute", "program", "quota", "seat_type", "gender"
    )


@query(
    "default_nulls",
    f"SELECT {_KEY}, coalesce(CAST(trunc({numeric('year')}) AS INT), {fx.YEAR}) AS year, "
    f"coalesce({numeric('round')}, 0.0) AS round, coalesce(quota, 'AI') AS quota, "
    "coalesce(seat_type, 'OPEN') AS seat_type FROM raw",
)
def default_nulls(spark, sf):
    typed = C.coerce_numeric(fx.raw_cutoffs(spark, sf), ["year", "round"]).withColumn(
        "year", F.col("year").cast("int")
    )
    return C.default_nulls(typed, fx.YEAR).select(
        *_KEY.split(", "), "year", "round", "quota", "seat_type"
    )


@query("normalise_gender", f"SELECT {_KEY}, {pool('gender')} AS gender_pool FROM raw")
def normalise_gender(spark, sf):
    return C.normalise_gender(fx.raw_cutoffs(spark, sf)).select(*_KEY.split(", "), "gender_pool")


_PROGRAM = PROGRAM_PATTERN


@query(
    "split_program",
    f"""SELECT line, l_linenumber,
        CASE WHEN regexp_matches(p, '{_PROGRAM}') THEN trim(regexp_extract(p, '{_PROGRAM}', 1))
            ELSE p END AS branch,
        CASE WHEN regexp_matches(p, '{_PROGRAM}')
            THEN trim(string_split(regexp_extract(p, '{_PROGRAM}', 2), ',')[-1])
            ELSE '' END AS degree
    FROM (SELECT line, l_linenumber, {trimmed('program')} AS p FROM raw WHERE program IS NOT NULL)""",
)
def split_program(spark, sf):
    return fx.raw_cutoffs(spark, sf).where("program is not null").select(
        "line",
        "l_linenumber",
        X.program_branch(F.col("program")).alias("branch"),
        X.program_degree(F.col("program")).alias("degree"),
    )


@query(
    "to_int_rank",
    f"SELECT {_KEY}, CAST(trunc({numeric('opening_rank')} * 1.37) AS BIGINT) AS rank FROM raw",
)
def to_int_rank(spark, sf):
    value = X.numeric(F.col("opening_rank")) * F.lit(1.37)
    return fx.raw_cutoffs(spark, sf).select(*_KEY.split(", "), X.whole_rank(value).alias("rank"))


@query("year_filter", f"SELECT line, institute, program, closing_rank FROM cutoffs WHERE year = {fx.YEAR}")
def year_filter(spark, sf):
    return fx.cutoffs(spark, sf).where(F.col("year") == fx.YEAR).select(
        "line", "institute", "program", "closing_rank"
    )


@query(
    "adhoc_filter",
    "SELECT line, institute, program, round, closing_rank, opening_rank FROM cutoffs "
    "WHERE round = 3 AND institute = 'Supplier#000000001' "
    "ORDER BY line, closing_rank, opening_rank, program LIMIT 20",
)
def adhoc_filter(spark, sf):
    picked = fx.cutoffs(spark, sf).where("round = 3 and institute = 'Supplier#000000001'")
    return (
        picked.select("line", "institute", "program", "round", "closing_rank", "opening_rank")
        .orderBy("line", "closing_rank", "opening_rank", "program")
        .limit(20)
    )


@query(
    "materialise",
    "SELECT institute, seat_type, count(*) AS n FROM cutoffs WHERE year = 1999 GROUP BY ALL",
)
def materialised(spark, sf):
    kept = materialise(fx.cutoffs(spark, sf))
    return kept.where("year = 1999").groupBy("institute", "seat_type").agg(F.count("*").alias("n"))


@query(
    "effective_mode",
    "SELECT profile_id, CASE WHEN profile_id % 3 = 0 THEN 'extended' ELSE 'basic' END AS mode "
    "FROM profiles",
)
def effective_modes(spark, sf):
    asked = F.when(F.col("profile_id") % 3 == 0, "extended").when(
        F.col("profile_id") % 3 == 1, "basic"
    )
    return fx.profiles(spark, sf).select(
        "profile_id", effective_mode(asked, True, "basic").alias("mode")
    )
