"""All registered queries; importing the modules fills the registry."""

from plumbline.plans import (  # noqa: F401
    document_queries, event_queries, finance_queries, referral_queries, rent_queries, stream_queries,
)
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
