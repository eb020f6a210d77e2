"""Registered queries, each with its SQL where SQL can express it."""

from . import detection, evidence, floor, frames, imaging, machines, proposal, relational, settings
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "detection", "evidence", "floor", "frames", "imaging", "machines", "proposal", "relational", "settings"]
