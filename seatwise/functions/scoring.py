"""Interest score and admission probability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seatwise.dims import values as V
from seatwise.functions.classify import TAG_BITS


def blended_score(branch: Column, brand: Column, ratio: Column) -> Column:
    """Ratio 0 counts the branch only, ratio 1 the institute's brand only. Not rounded."""
    return (F.lit(1.0) - ratio) * branch + ratio * (brand * F.lit(10.0))


def interest_score(branch: Column, brand: Column, ratio: Column) -> Column:
    return F.round(blended_score(branch, brand, ratio), 2)


def goal_weight_array(mask: Column) -> Column:
    """Best tag weight of a tag bit set for each goal, in the fixed goal order; 0 for none."""
    weights = []
    for goal in V.GOALS:
        table = V.GOAL_WEIGHTS[goal]
        weight = F
        for value in sorted(set(table.values()), reverse=True):
            members = sum(TAG_BITS[t] for t, w in table.items() if w == value)
            weight = weight.when(mask.bitwiseAND(members) != 0, F.lit(float(value)))
        weights.append(weight.otherwise(F.lit(0.0)))
    return F.array(*weights)


def goal_index(goal: Column) -> Column:
    index = F
    for i, name in enumerate(V.GOALS):
        index = index.when(goal == name, i)
    return index


def volatility(years: Column, deviation: Column, closing: Column) -> Column:
    """Population deviation over two years or more, else a share of the closing rank; floored."""
    spread = F.when(years >= 2, deviation).otherwise(F.lit(V.DEFAULT_VOLATILITY) * closing)
    return F.greatest(
        spread,
        F.lit(float(V.MIN_VOLATILITY_RANKS)),
        F.lit(V.MIN_VOLATILITY) * closing,
    )


def admission_probability(rank: Column, closing: Column, sigma: Column) -> Column:
    z = (closing - rank) / sigma
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-V.LOGIT_SLOPE) * z)) * F.lit(100.0), 1)
