"""All registered queries."""

from wardlens.plans import (  # noqa: F401
    cohort_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    text_queries,
)
from wardlens.plans.registry import COVERS, QUERIES, TWINS

__all__ = ["COVERS", "QUERIES", "TWINS"]
