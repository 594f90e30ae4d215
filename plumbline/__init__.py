"""Product-event analytics and property-management tables as Spark jobs."""

from plumbline.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
