"""All registered queries."""

from skysense.queries import air, cleaning, feature, ml, profiles, scores, stream, tables  # noqa: F401
from skysense.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
