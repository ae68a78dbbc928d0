"""Registered queries and their SQL."""

from rubricon.catalog import consensus, grading, index, records, reports, retrieval, rubrics  # noqa: F401
from rubricon.catalog.base import QUERIES, SQL  # noqa: F401
