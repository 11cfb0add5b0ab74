"""The fixed values and the wording as small DataFrames (all below 300 rows)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.dims import values as V
from seatwise.dims.wording import GOAL_LABELS, SEAT_LABELS, WORDING

_ARROW = {str: pa.string(), int: pa.int32(), float: pa.float64(), bool: pa.bool_()}


def literal_table(spark: SparkSession, columns: dict[str, type], rows: list[tuple]) -> DataFrame:
    """A local relation of fixed rows; its size is known, so it may be broadcast."""
    arrays = [
        pa.array([row[i] for row in rows], type=_ARROW[kind])
        for i, kind in enumerate(columns.values())
    ]
    return F.broadcast(spark.createDataFrame(pa.table(arrays, names=list(columns))))


def institute_states(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        {"institute": str, "mapped_state": str},
        list(V.INSTITUTE_STATES.items()),
    )


def states(spark: SparkSession) -> DataFrame:
    rows = [(i, s, s.lower()) for i, s in enumerate(V.STATES)]
    return literal_table(spark, {"state_order": int, "state": str, "state_lower": str}, rows)


def goal_labels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"goal": str, "goal_label": str}, list(GOAL_LABELS.items()))


def wording(spark: SparkSession) -> DataFrame:
    rows = [(lang, k, text) for lang, table in WORDING.items() for k, text in table.items()]
    return literal_table(spark, {"lang": str, "key": str, "text": str}, rows)


def wording_maps(spark: SparkSession) -> DataFrame:
    """One row per language: key -> text, with the English text where a language has none."""
    return F.broadcast(
        spark.range(1).select(
            F.explode(F.create_map(*[
                part
                for lang, table in WORDING.items()
                for part in (
                    F.lit(lang),
                    F.create_map(*[
                        F.lit(x) for pair in {**WORDING["en"], **table}.items() for x in pair
                    ]),
                )
            ])).alias("text_lang", "texts")
        )
    )


def option_rows() -> list[tuple[str, int, str, str, bool]]:
    """Form options: kind, position, value, label, available without multi-year data."""
    rows = [("state", i, s, s, True) for i, s in enumerate(V.STATES)]
    rows += [("goal", i, g, GOAL_LABELS[g], True) for i, g in enumerate(V.GOALS)]
    rows += [("gender", i, g, g, True) for i, g in enumerate(V.GENDERS)]
    rows += [
        ("category", i, c, SEAT_LABELS[c], c == V.DEFAULT_SEAT_CATEGORY)
        for i, c in enumerate(V.SEAT_CATEGORIES)
    ]
    rows += [
        ("branch", i, p, WORDING["en"][f"pref.{p}"], True)
        for i, p in enumerate(V.PREFERENCE_TAGS)
    ]
    return rows
