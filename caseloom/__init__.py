"""caseloom: evidence ingestion, retrieval and investigation as Spark jobs."""

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.session import build_session, configure

__all__ = ["DEFAULTS", "Defaults", "build_session", "configure"]
