"""All registered queries."""

from weirflow.plans import business, knowledge, medallion, pipelines, tools  # noqa: F401
from weirflow.plans.registry import QUERIES

__all__ = ["QUERIES"]
