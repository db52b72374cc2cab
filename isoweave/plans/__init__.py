"""Registered queries over the driver's tables and the SQL that they are held against."""

from . import more  # noqa: F401  registers its queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
