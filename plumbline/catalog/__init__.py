"""All catalog queries, bound to the test tables, with the SQL they must agree with."""

from . import arrays, curate, evaluate, heads, samples, split  # noqa: F401 - importing registers the queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
