"""The relational query pack: one builder and one oracle for every query."""

from . import aggregates, filters, integrity, joins, measures, setops, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "filters", "integrity", "joins", "measures", "setops", "windows"]
