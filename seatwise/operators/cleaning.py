"""From raw text rows to typed cutoff rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seatwise.dims import values as V
from seatwise.functions.text import normalised_gender, numeric, trimmed, whole_rank

REQUIRED = ["institute", "program", "opening_rank", "closing_rank"]


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=REQUIRED)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(F.col(c)) for c in columns})


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.withColumns(
        {f.name: trimmed(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    )


def default_nulls(df: DataFrame, year: int = V.DEFAULT_YEAR) -> DataFrame:
    """Year, round, quota and seat type of rows that lack them."""
    defaults = {
        "year": F.lit(year),
        "round": F.lit(0.0),
        "quota": F.lit(V.DEFAULT_QUOTA),
        "seat_type": F.lit(V.DEFAULT_SEAT_CATEGORY),
    }
    return df.withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in df.columns}
    )


def year_column(df: DataFrame, year: int = V.DEFAULT_YEAR) -> Column:
    if "year" not in df.columns:
        return F.lit(year)
    return F.coalesce(numeric(F.col("year")).try_cast("int"), F.lit(year))


def round_column(df: DataFrame) -> Column:
    """Round number, 0 where it is missing or no number."""
    return F.coalesce(numeric(F.col("round")), F.lit(0.0))


def typed_cutoffs(df: DataFrame, year: int = V.DEFAULT_YEAR) -> DataFrame:
    """Rows with an institute, a program and two finite ranks; numbers typed, year defaulted."""
    typed = drop_incomplete(df).withColumns(
        {
            "opening_rank": whole_rank(numeric(F.col("opening_rank"))),
            "closing_rank": whole_rank(numeric(F.col("closing_rank"))),
            "year": year_column(df, year),
        }
    )
    return drop_incomplete(typed)


def normalise_gender(df: DataFrame) -> DataFrame:
    return df.withColumn("gender_pool", normalised_gender(F.col("gender")))
