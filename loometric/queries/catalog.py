"""All registered queries."""

from loometric.queries import apply, evaluate, prepare, sequence, text  # noqa: F401
from loometric.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
