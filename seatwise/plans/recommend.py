"""End to end: profiles and cutoffs to ranked, explained recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.dims import values as V
from seatwise.functions import classify, scoring
from seatwise.operators import matching, programs as P, results, rounds, views
from seatwise.operators.cleaning import typed_cutoffs
from seatwise.session import written
from seatwise.sources.cutoffs import effective_mode


def extended_programs(
    cutoffs: DataFrame, year: int = V.DEFAULT_YEAR, lines: list[str] = ("line",)
) -> DataFrame:
    """Programs of the target year with the history of all years."""
    seats = P.build_programs(rounds.last_round_programs(cutoffs, year, lines))
    history = P.program_history(rounds.last_round_history(cutoffs, lines))
    return seat_table(seats, "extended", history, year)


def basic_programs(snapshot: DataFrame, year: int = V.DEFAULT_YEAR) -> DataFrame:
    """Programs of a single-year table, without history."""
    return seat_table(P.build_programs(snapshot, "nan"), "basic", None, year)


def seat_table(
    programs: DataFrame, mode: str, history: DataFrame | None, year: int = V.DEFAULT_YEAR
) -> DataFrame:
    """All that depends on the seat alone, computed once per seat instead of once per match.

    The programs are read three times, for themselves and both advantages, and so written first.
    """
    full = P.with_history(P.with_advantages(written(programs)), history, year)
    return full.withColumns(
        {
            "data_mode": F.lit(mode),
            "confidence": classify.confidence_band(F.col("opening_rank"), F.col("closing_rank")),
            "region": classify.region_of(F.col("institute_state")),
            "is_metro": classify.is_metro(F.col("institute"), F.col("institute_state")),
        }
    )


def ready_seats(seats: DataFrame) -> DataFrame:
    """The seat table with its match columns, written so that ids and sizes are fixed.

    It is also written before: ids come from a sort by ranges, which makes its input twice.
    """
    return written(matching.with_match_columns(written(seats)))


def recommend(
    profiles: DataFrame,
    seats: DataFrame,
    texts: bool = True,
    allow_toggle: bool = True,
    default: str = "basic",
) -> DataFrame:
    """Top recommendations per valid profile; ``seats`` comes from ``ready_seats`` or ``ingest``.

    A profile is matched with the seats of the dataset it asks for, or of ``default`` if the caller
    does not allow a choice; any other mode means basic.
    """
    mode = effective_mode(F.col("data_mode"), allow_toggle, default)
    profiles = profiles.withColumn("data_mode", mode)
    top = matching.top_matches(profiles, seats).withColumn(
        "admission_probability",
        scoring.admission_probability(F.col("rank"), F.col("closing_rank"), F.col("sigma")),
    )
    if not texts:
        return top
    return results.with_reason(top.join(profiles.select("profile_id", "lang"), "profile_id"))


def respond(profiles: DataFrame, seats: DataFrame, **options) -> dict[str, DataFrame]:
    """The whole answer to ``profiles``; the matches are made and written once.

    ``rows``, ``counts``, ``notes``, ``guidance``, ``goal_guidance``, ``category_guidance``, ``share``,
    ``flags`` and ``colleges``; ``options`` as for ``recommend``.
    """
    rows = written(recommend(profiles, seats, **options))
    counts = written(results.result_counts(profiles, rows))
    return {
        "rows": rows,
        "counts": counts,
        "notes": results.profile_notes(profiles, counts),
        "guidance": results.guidance_text(counts),
        "goal_guidance": results.goal_guidance(profiles),
        "category_guidance": results.category_guidance(counts),
        "share": results.share_summary(counts, views.top_picks(rows)),
        "flags": views.empty_flags(profiles, rows, views.visible(rows)),
        "colleges": views.college_groups(rows),
    }


def ingest(
    raw: DataFrame,
    year: int = V.DEFAULT_YEAR,
    lines: list[str] = ("line",),
    snapshot: DataFrame | None = None,
) -> DataFrame:
    """Raw multi-year rows, and a raw single-year table for basic mode, to the written seat table."""
    typed = written(typed_cutoffs(raw, year), ["year"])
    seats = extended_programs(typed, year, lines)
    if snapshot is not None:
        basic = basic_programs(typed_cutoffs(snapshot, year), year)
        seats = seats.unionByName(basic, allowMissingColumns=True)
    return ready_seats(seats)
