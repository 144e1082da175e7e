"""stationflow: Spark operators for keyed hourly station series."""

from .session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
