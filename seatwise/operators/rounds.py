"""The last-round reductions.

All four keep one row per key and differ in how they treat ties, missing rounds and missing key
values. Each is a ``row_number() = 1`` window: Spark keeps a single row per key on the map side
already (WindowGroupLimit), so a key that owns a third of all rows sends one row per task, not
its rows, through the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.dims import values as V
from seatwise.functions.text import normalised_gender, numeric, trimmed
from seatwise.operators.cleaning import round_column, trim_strings

SEAT_KEY = ["institute", "program", "quota", "seat_type", "gender"]
HISTORY_KEY = ["institute", "program", "quota", "seat_type", "gender_pool"]


def first_row(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """The first row per key. The hash in front makes the sort compare one number, not texts."""
    rank = F.row_number().over(Window.partitionBy("_hash", *keys).orderBy(*order))
    return (
        df.withColumn("_hash", F.xxhash64(*keys))
        .withColumn("_rank", rank)
        .where("_rank = 1")
        .drop("_rank", "_hash")
    )


def _lines(lines: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in lines]


@dataclass(frozen=True)
class LastRound:
    """A rule: the rows it takes, with ``_round``, their key, and which row of a key is its last.

    The last row of some rows is that of the last rows of their parts, so parts can be reduced on their own.
    """

    rows: Callable[[DataFrame, Sequence[str]], DataFrame]
    keys: Sequence[str]
    unknown_round_wins: bool = False
    last_line_wins: bool = False

    def last(self, rows: DataFrame, lines: Sequence[str]) -> DataFrame:
        latest = F.desc_nulls_first("_round") if self.unknown_round_wins else F.desc("_round")
        return first_row(rows, self.keys, [latest, *_lines(lines, self.last_line_wins)])


def _program_rows(cutoffs: DataFrame, lines: Sequence[str]) -> DataFrame:
    return cutoffs.dropna(subset=SEAT_KEY).withColumn("_round", round_column(cutoffs))


def _history_rows(cutoffs: DataFrame, lines: Sequence[str]) -> DataFrame:
    return cutoffs.select(
        trimmed(F.col("institute")).alias("institute"),
        trimmed(F.col("program")).alias("program"),
        F.coalesce(trimmed(F.col("quota")), F.lit(V.DEFAULT_QUOTA)).alias("quota"),
        F.coalesce(trimmed(F.col("seat_type")), F.lit(V.DEFAULT_SEAT_CATEGORY)).alias("seat_type"),
        normalised_gender(F.col("gender")).alias("gender_pool"),
        "year",
        "closing_rank",
        (round_column(cutoffs) if "round" in cutoffs.columns else F.lit(0.0)).alias("_round"),
        *lines,
    )


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"round": numeric(F.col("round")), "year": numeric(F.col("year"))})


def _clean_rows(raw: DataFrame, lines: Sequence[str]) -> DataFrame:
    return _numbered(trim_strings(raw)).withColumn("_round", F.col("round"))


def _notebook_rows(raw: DataFrame, lines: Sequence[str]) -> DataFrame:
    rows = _numbered(raw).where(F.col("round").isNotNull()).dropna(subset=[*SEAT_KEY, "year"])
    return rows.withColumn("_round", F.col("round"))


RULES = {
    "programs": LastRound(_program_rows, [*SEAT_KEY, "year"]),
    "history": LastRound(_history_rows, [*HISTORY_KEY, "year"], last_line_wins=True),
    "clean": LastRound(_clean_rows, [*SEAT_KEY, "year"], unknown_round_wins=True, last_line_wins=True),
    "notebook": LastRound(_notebook_rows, [*SEAT_KEY, "year"]),
}


def _last(rule: str, rows: DataFrame, lines: Sequence[str]) -> DataFrame:
    return RULES[rule].last(RULES[rule].rows(rows, lines), lines).drop("_round")


def last_round_programs(
    cutoffs: DataFrame, year: int = V.DEFAULT_YEAR, lines: Sequence[str] = ("line",)
) -> DataFrame:
    """Target-year rows: missing round counts as 0, the first of a tie wins, null keys drop."""
    rows = cutoffs.where(F.col("year") == year)
    return _last("programs", rows, lines) if "round" in cutoffs.columns else rows


def last_round_history(cutoffs: DataFrame, lines: Sequence[str] = ("line",)) -> DataFrame:
    """Closing rank per normalised seat and year: null keys get defaults, the last of a tie wins.

    The highest round of all raw spellings of a seat is the highest of their highest rounds, so
    one reduction on the normalised key does both steps.
    """
    return _last("history", cutoffs, lines).select(*HISTORY_KEY, "year", "closing_rank")


def last_round_clean(raw: DataFrame, lines: Sequence[str] = ("line",)) -> DataFrame:
    """Trimmed raw rows: a round that is no number wins, the last of a tie wins, null keys stay."""
    return _last("clean", raw, lines)


def last_round_notebook(raw: DataFrame, lines: Sequence[str] = ("line",)) -> DataFrame:
    """Raw rows with a numeric round: the first of a tie wins, null keys drop; sorted."""
    return _last("notebook", raw, lines).orderBy("year", "institute", "program")
