"""Imports every module that registers queries."""

from tierbook.plans import attributes, catalogue, deidentify, maintenance, streams, transfers  # noqa: F401
from tierbook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
