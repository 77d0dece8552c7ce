"""Importing the plan modules registers their queries."""

from affinis.plans import (  # noqa: F401
    least_squares,
    neighbourhood,
    preparation,
    secure_sum,
    serving,
    spectral,
    statistics,
    streams,
    trained,
)
from affinis.plans.registry import ORACLES, QUERIES  # noqa: F401
