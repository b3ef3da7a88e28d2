"""aeroquant: trip-duration analytics as PySpark DataFrame jobs."""

from aeroquant.session import build_session, checkpoint_dir, tune

__all__ = ["build_session", "checkpoint_dir", "tune"]
