"""Who may apply for which seat, as row predicates and as equi-join keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seatwise.dims import values as V


def passes_gender(gender_pool: Column, gender: Column) -> Column:
    return (gender == "female") | (gender_pool == "neutral")


def _seat_state(quota: Column, state: Column) -> Column:
    """The only state whose candidates may take the seat; null for other quotas."""
    only = F.when(quota == "HS", state)
    for code, owner in V.SPECIAL_QUOTA_STATES.items():
        only = only.when(quota == code, owner)
    return only


def _open_to_all(kind: Column, quota: Column) -> Column:
    restricted = ["HS", "OS", *V.SPECIAL_QUOTA_STATES]
    return (kind == "IIT") | F.coalesce(~quota.isin(restricted), F.lit(True))


def passes_quota(kind: Column, quota: Column, state: Column, home_state: Column) -> Column:
    return (
        F.when(_open_to_all(kind, quota), F.lit(True))
        .when(quota == "OS", state != home_state)
        .otherwise(_seat_state(quota, state) == home_state)
    )


def seat_access(gender_pool: Column, kind: Column, quota: Column, state: Column) -> Column:
    """One key per seat that says which candidates reach it; partner of ``profile_access``."""
    return F.concat(
        gender_pool,
        F.when(_open_to_all(kind, quota), "|any")
        .when(quota == "OS", "|out")
        .otherwise(F.concat(F.lit("|in:"), _seat_state(quota, state))),
    )


def profile_access(gender: Column, home_state: Column) -> Column:
    """Every seat key a candidate reaches. ``|out`` still needs state <> home state."""

    def keys(pool: str) -> list[Column]:
        return [
            F.lit(f"{pool}|any"),
            F.lit(f"{pool}|out"),
            F.concat(F.lit(f"{pool}|in:"), home_state),
        ]

    return F.when(gender == "female", F.array(*keys("neutral"), *keys("female"))).otherwise(
        F.array(*keys("neutral"))
    )


def relevant_rank(exam: Column, adv_rank: Column, mains_rank: Column) -> Column:
    return F.when(exam == "advanced", adv_rank).otherwise(mains_rank)


def passes_seat(mode: Column, wanted: Column, seat_type: Column) -> Column:
    """Basic data and the empty category know no seat filter."""
    return (mode == "basic") | (wanted == "") | (seat_type == wanted)


def shares_tag(tags: Column, wanted: Column) -> Column:
    return (F.size(wanted) == 0) | F.arrays_overlap(tags, wanted)
