"""All registered queries; importing this module fills the registry."""

from . import (  # noqa: F401
    dispatch_queries, forecast_queries, io_queries, movement_queries, scan_queries)
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
