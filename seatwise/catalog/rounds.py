"""Last-round reductions, history, advantages, whole-table summaries."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from seatwise import fixtures as fx
from seatwise.dims import values as V
from seatwise.catalog.common import history_text
from seatwise.catalog.registry import CTES, numeric, pool, query, quoted, trimmed
from seatwise.dims import tables
from seatwise.operators import cleaning as C, programs as P, rounds as R, summaries as S
from seatwise.operators.choices import numbered_by
from seatwise.session import shared_folder
from seatwise.sources import cutoffs as src
from seatwise.sources.round_state import fold_rounds, folded_rounds

CTES["spreads"] = "SELECT CAST(closing_rank - opening_rank AS DOUBLE) AS s FROM programs"

_KEY = "institute, program, quota, seat_type, gender"
_TIES = ", ".join(fx.LINES)
_TIES_DOWN = ", ".join(f"{c} DESC" for c in fx.LINES)
_TRIMMED = ", ".join(
    f"{trimmed(c)} AS {c}" for c in ("institute", "program", "quota", "seat_type", "gender")
)

CTES["typed_ends"] = f"""
    SELECT institute, program, quota, seat_type, gender, opening_rank, closing_rank, round, line
    FROM typed WHERE year = {fx.YEAR} AND institute IS NOT NULL AND program IS NOT NULL
        AND quota IS NOT NULL AND seat_type IS NOT NULL AND gender IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {_KEY}
        ORDER BY coalesce({numeric('round')}, 0) DESC, {_TIES}) = 1"""
CTES["typed_history"] = f"""
    SELECT institute, program, quota, seat_type, gender_pool, year, closing_rank FROM
        (SELECT {trimmed('institute')} AS institute, {trimmed('program')} AS program,
            coalesce({trimmed('quota')}, 'AI') AS quota,
            coalesce({trimmed('seat_type')}, 'OPEN') AS seat_type, {pool('gender')} AS gender_pool,
            year, closing_rank, coalesce({numeric('round')}, 0) AS r, {_TIES} FROM typed)
    QUALIFY row_number() OVER (PARTITION BY institute, program, quota, seat_type, gender_pool, year
        ORDER BY r DESC, {_TIES_DOWN}) = 1"""
CTES["clean_ends"] = f"""
    SELECT * FROM (SELECT {_TRIMMED}, {trimmed('opening_rank')} AS opening_rank,
            {trimmed('closing_rank')} AS closing_rank, {numeric('year')} AS year,
            {numeric('round')} AS round, {_TIES} FROM raw)
    QUALIFY row_number() OVER (PARTITION BY {_KEY}, year
        ORDER BY round DESC NULLS FIRST, {_TIES_DOWN}) = 1"""
CTES["notebook_ends"] = f"""
    SELECT * FROM (SELECT {_KEY}, opening_rank, closing_rank, {numeric('year')} AS year,
            {numeric('round')} AS round, {_TIES} FROM raw)
    WHERE round IS NOT NULL AND year IS NOT NULL AND institute IS NOT NULL AND program IS NOT NULL
        AND quota IS NOT NULL AND seat_type IS NOT NULL AND gender IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {_KEY}, year ORDER BY round DESC, {_TIES}) = 1"""

_ROW = f"{_KEY}, opening_rank, closing_rank, round, line"
_ROW_COLUMNS = _ROW.split(", ")


@query("last_round_programs", f"SELECT {_ROW} FROM typed_ends")
def last_round_programs(spark, sf):
    typed = C.typed_cutoffs(fx.raw_cutoffs(spark, sf), fx.YEAR)
    return R.last_round_programs(typed, fx.YEAR, fx.LINES).select(*_ROW_COLUMNS)


@query("last_round_history", "SELECT * FROM typed_history")
def last_round_history(spark, sf):
    return R.last_round_history(C.typed_cutoffs(fx.raw_cutoffs(spark, sf), fx.YEAR), fx.LINES)


@query("last_round_clean", f"SELECT {_ROW}, year FROM clean_ends")
def last_round_clean(spark, sf):
    return R.last_round_clean(fx.raw_cutoffs(spark, sf), fx.LINES).select(*_ROW_COLUMNS, "year")


@query("last_round_notebook", f"SELECT {_ROW}, year FROM notebook_ends")
def last_round_notebook(spark, sf):
    return R.last_round_notebook(fx.raw_cutoffs(spark, sf), fx.LINES).select(*_ROW_COLUMNS, "year")


@query(
    "notebook_sort",
    f"""SELECT row_number() OVER (ORDER BY year, institute, program, {_TIES}) AS place,
        year, institute, program, line, closing_rank FROM notebook_ends""",
)
def notebook_sort(spark, sf):
    """The sorted rows with their places, numbered in sorted ranges."""
    kept = R.last_round_notebook(fx.raw_cutoffs(spark, sf), fx.LINES)
    order = F.struct("year", "institute", "program", *fx.LINES)
    rows = numbered_by(kept.select("*", F.lit(0).alias("user_id"), order.alias("seq")))
    return rows.select(
        F.col("position").alias("place"), "year", "institute", "program", "line", "closing_rank"
    )


def _folded(spark, sf, rule):
    """Two loads that share years, keys and rounds, folded one after the other; the second one twice."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = fx.raw_cutoffs(spark, sf)
    rows = C.typed_cutoffs(rows, fx.YEAR) if rule in ("programs", "history") else rows
    odd = F.col("l_linenumber") % 2 == 1
    for load in (rows.where(odd), rows.where(~odd), rows.where(~odd)):
        fold_rounds(load, path, rule, fx.LINES)
    found = folded_rounds(spark, path, rule)
    return found.withColumn("year", F.col("year").cast(R.RULES[rule].rows(rows, fx.LINES).schema["year"].dataType))


@query("fold_programs", f"SELECT {_ROW} FROM typed_ends")
def fold_programs(spark, sf):
    return _folded(spark, sf, "programs").where(F.col("year") == fx.YEAR).select(*_ROW_COLUMNS)


@query("fold_history", "SELECT * FROM typed_history")
def fold_history(spark, sf):
    return _folded(spark, sf, "history")


@query("fold_clean", f"SELECT {_ROW}, year FROM clean_ends")
def fold_clean(spark, sf):
    return _folded(spark, sf, "clean").select(*_ROW_COLUMNS, "year")


@query("fold_notebook", f"SELECT {_ROW}, year FROM notebook_ends")
def fold_notebook(spark, sf):
    return _folded(spark, sf, "notebook").select(*_ROW_COLUMNS, "year")


@query(
    "write_last_round",
    f"""SELECT year, seat_type, institute IS NULL AS unnamed, count(*) AS n,
        CAST(sum({numeric('closing_rank')}) AS BIGINT) AS closing
    FROM clean_ends GROUP BY ALL""",
)
def write_last_round(spark, sf):
    """Written as CSV and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    kept = R.last_round_clean(fx.raw_cutoffs(spark, sf), fx.LINES)
    src.write_last_round(kept.drop(*fx.LINES[1:]), path)
    typed = C.coerce_numeric(src.read_cutoffs(spark, path), ["year", "closing_rank"])
    return typed.groupBy("year", "seat_type", F.col("institute").isNull().alias("unnamed")).agg(
        F.count("*").alias("n"), F.sum("closing_rank").cast("bigint").alias("closing")
    )


def _two_files(spark, sf) -> str:
    """Raw rows as CSV files of two column orders, one with line breaks in its texts."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = fx.raw_cutoffs(spark, sf)
    one = rows.where("l_linenumber % 2 = 0").drop(*fx.LINES[1:])
    two = rows.where("l_linenumber % 2 = 1").drop(*fx.LINES[1:])
    broken = two.withColumn("program", F.replace("program", F.lit(" ("), F.lit("\n(")))
    src.write_last_round(one, f"{path}/one")
    src.write_last_round(broken.select(*broken.columns[::-1]), f"{path}/two")
    return f"{path}/*"


_BROKEN = f"""CASE WHEN l_linenumber % 2 = 1 THEN replace({trimmed('program')}, ' (', chr(10) || '(')
    ELSE {trimmed('program')} END"""


_READ = f"""SELECT {trimmed('institute')} AS institute, {_BROKEN} AS program, {trimmed('quota')} AS quota,
        year, round, count(*) AS n FROM raw GROUP BY ALL"""


def _counted(rows):
    key = ["institute", "program", "quota", "year", "round"]
    return C.trim_strings(rows).groupBy(*key).agg(F.count("*").alias("n"))


@query("read_cutoffs", _READ)
def read_cutoffs(spark, sf):
    """CSV files with source headers in different order, read by header name."""
    return _counted(src.read_cutoffs(spark, _two_files(spark, sf), multiline=True))


@query("read_cutoffs_split", _READ)
def read_cutoffs_split(spark, sf):
    """The same files, records over several lines put together from splits."""
    return _counted(src.read_cutoffs(spark, _two_files(spark, sf), multiline="split"))


@query(
    "read_snapshot",
    f"SELECT {trimmed('institute')} AS institute, {trimmed('seat_type')} AS seat_type, count(*) AS n FROM raw GROUP BY ALL",
)
def read_snapshot(spark, sf):
    """The same files as a single-year table."""
    rows = C.trim_strings(src.read_snapshot(spark, _two_files(spark, sf), multiline=True))
    assert not {"year", "round"} & set(rows.columns)
    return rows.groupBy("institute", "seat_type").agg(F.count("*").alias("n"))


@query(
    "rename_columns",
    "SELECT institute, program, quota, closing_rank FROM cutoffs",
)
def rename_columns(spark, sf):
    """Source headers back to column names."""
    headers = {v: k for k, v in V.SOURCE_COLUMNS.items()}
    rows = fx.cutoffs(spark, sf).withColumnsRenamed(headers)
    return src.rename_columns(rows).select("institute", "program", "quota", "closing_rank")


@query("require_columns", "SELECT institute, count(*) AS n FROM cutoffs GROUP BY institute")
def require_columns(spark, sf):
    rows = src.require_columns(fx.cutoffs(spark, sf), ["institute", "program"])
    return rows.groupBy("institute").agg(F.count("*").alias("n"))


_LOADS = [("extended", True, "basic"), ("other", True, "extended"), ("basic", False, "extended")]


@query(
    "load_programs",
    " UNION ALL ".join(
        f"""SELECT '{mode} {allowed} {default}' AS asked, institute, count(*) AS n, sum(closing_rank)::BIGINT AS closing
        FROM {'cutoffs' if 'extended' == (mode if allowed else default) else 'programs'} GROUP BY institute"""
        for mode, allowed, default in _LOADS
    ),
)
def load_programs(spark, sf):
    """The table of the mode asked for, or of the default where there is no choice."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    paths = {"extended": f"{folder}/extended", "basic": f"{folder}/basic"}
    src.materialise(fx.cutoffs(spark, sf), paths["extended"])
    src.materialise(fx.programs(spark, sf), paths["basic"])
    found = [
        src.load_programs(spark, paths, mode, allowed, default).select(
            F.lit(f"{mode} {allowed} {default}").alias("asked"), "institute", "closing_rank"
        )
        for mode, allowed, default in _LOADS
    ]
    rows = functools.reduce(lambda a, b: a.unionByName(b), found)
    return rows.groupBy("asked", "institute").agg(
        F.count("*").alias("n"), F.sum("closing_rank").cast("bigint").alias("closing")
    )


@query(
    "program_history",
    """SELECT institute, program, quota, seat_type, gender_pool,
        '{' || string_agg(CAST(year AS VARCHAR) || ' -> ' || CAST(closing_rank AS VARCHAR), ', '
            ORDER BY year) || '}' AS history, count(*) AS years
    FROM typed_history GROUP BY ALL""",
)
def program_history(spark, sf):
    typed = C.typed_cutoffs(fx.raw_cutoffs(spark, sf), fx.YEAR)
    history = P.program_history(R.last_round_history(typed, fx.LINES))
    return history.select(*R.HISTORY_KEY, history_text().alias("history"), "years")


@query(
    "rank_volatility",
    """SELECT institute, branch_full, quota, seat_type, gender_pool, round(sigma, 3) AS sigma
    FROM seats""",
)
def rank_volatility(spark, sf):
    history = P.program_history(fx.year_ends(spark, sf))
    return P.with_history(fx.programs(spark, sf), history, fx.YEAR).select(
        "institute",
        "branch_full",
        "quota",
        "seat_type",
        "gender_pool",
        F.round("sigma", 3).alias("sigma"),
    )


@query(
    "join_history",
    "SELECT institute, branch_full, quota, seat_type, gender_pool, history FROM seats",
)
def join_history(spark, sf):
    history = P.program_history(fx.year_ends(spark, sf))
    return P.with_history(fx.programs(spark, sf), history, fx.YEAR).select(
        "institute", "branch_full", "quota", "seat_type", "gender_pool",
        history_text().alias("history"),
    )


@query("home_state_advantage", "SELECT * FROM home_advantage")
def home_state_advantage(spark, sf):
    return P.home_state_advantage(fx.programs(spark, sf))


@query("female_seat_advantage", "SELECT * FROM female_advantage")
def female_seat_advantage(spark, sf):
    return P.female_seat_advantage(fx.programs(spark, sf))


_SEAT = "institute, branch_full, quota, seat_type, gender_pool, opening_rank, closing_rank"


@query("join_hs_advantage", f"SELECT {_SEAT}, home_state_advantage FROM seats")
def join_hs_advantage(spark, sf):
    return P.with_advantages(fx.programs(spark, sf)).select(
        *_SEAT.split(", "), "home_state_advantage"
    )


@query("join_female_advantage", f"SELECT {_SEAT}, female_seat_advantage FROM seats")
def join_female_advantage(spark, sf):
    return P.with_advantages(fx.programs(spark, sf)).select(
        *_SEAT.split(", "), "female_seat_advantage"
    )


@query("program_count", "SELECT count(*) AS programs FROM programs")
def program_count(spark, sf):
    return S.program_count(fx.programs(spark, sf))


@query(
    "load_summary",
    """SELECT a.n_rows, a.n_years, a.rounds, b.n_kept, a.n_rows - b.n_kept AS n_removed FROM
        (SELECT count(*) AS n_rows, count(DISTINCT year) AS n_years,
            string_agg(DISTINCT CAST(round AS VARCHAR), ',' ORDER BY CAST(round AS VARCHAR))
                AS rounds FROM cutoffs) a,
        (SELECT count(*) AS n_kept FROM year_ends) b""",
)
def load_summary(spark, sf):
    summary = S.load_summary(fx.cutoffs(spark, sf), fx.year_ends(spark, sf))
    texts = F.transform("rounds", lambda r: r.cast("string"))
    return summary.withColumn("rounds", F.array_join(texts, ","))


@query("round_distribution", "SELECT year, round, count(*) AS n_rows FROM cutoffs GROUP BY ALL")
def round_distribution(spark, sf):
    return S.round_distribution(fx.cutoffs(spark, sf))


@query(
    "spread_profile",
    """SELECT 'p25' AS measure, round(quantile_cont(s, 0.25), 4) AS value FROM spreads
    UNION ALL SELECT 'median', round(quantile_cont(s, 0.5), 4) FROM spreads
    UNION ALL SELECT 'p66', round(quantile_cont(s, 0.66), 4) FROM spreads
    UNION ALL SELECT 'inverted', CAST(count(*) FILTER (s <= 0) AS DOUBLE) FROM spreads""",
)
def spread_profile(spark, sf):
    return S.spread_profile(fx.programs(spark, sf)).withColumn("value", F.round("value", 4))


def _option_sql() -> str:
    rows = ", ".join(
        f"('{k}', {i}, {quoted(v)}, {quoted(label)}, {k != 'category' or always})"
        for k, i, v, label, always in tables.option_rows()
    )
    return (
        "SELECT kind, position, value, label, always OR "
        "(SELECT count(DISTINCT year) > 1 FROM cutoffs) AS available "
        f"FROM (VALUES {rows}) AS t(kind, position, value, label, always)"
    )


query("distinct_dims", _option_sql())(lambda spark, sf: S.distinct_dims(fx.cutoffs(spark, sf)))
