"""Registered queries: importing this package fills ``QUERIES``."""

from deskline.plans import (  # noqa: F401
    q_contracts, q_devices, q_documents, q_feeds, q_ingest, q_kpis, q_streams, q_tickets,
)
from deskline.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
