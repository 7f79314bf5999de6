"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from areapanel.catalog import aggregates, areas, cleaning, joins, missing, modelling, panels, pipelines, sources  # noqa: F401
from areapanel.catalog.base import CATALOG

__all__ = ["CATALOG"]
