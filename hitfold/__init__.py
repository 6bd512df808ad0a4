"""Web access-log analytics expressed as PySpark DataFrame jobs."""

from hitfold.options import Options

__all__ = ["Options"]
