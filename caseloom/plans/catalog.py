"""All registered queries."""

from caseloom.plans import catalog_ingest, catalog_reports, catalog_retrieval, catalog_text  # noqa: F401
from caseloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
