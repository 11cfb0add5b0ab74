"""Registered queries: each operator on tables derived from the test data, with oracle SQL."""

from seatwise.catalog.registry import ORACLES, QUERIES
from seatwise.catalog import (  # noqa: F401  (registration)
    attributes,
    choice_lists,
    cleaning,
    matches,
    outputs,
    rounds,
)

__all__ = ["ORACLES", "QUERIES"]
