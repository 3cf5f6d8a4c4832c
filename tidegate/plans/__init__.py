"""Plans over whole pipelines, and the queries registered for the driver."""

from . import evaluation, preparation, triage_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "preparation", "triage_queries"]
