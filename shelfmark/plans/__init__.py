"""Queries over the given tables, one module per group of operators."""

from . import q_dashboard, q_identity, q_intake, q_maintenance, q_matching, q_resolve, q_resources, q_search, q_works  # noqa: F401
from .registry import QUERIES  # noqa: F401
