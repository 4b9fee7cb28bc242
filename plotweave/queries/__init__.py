"""One query per operator over the given tables, each next to the SQL that checks it."""

from plotweave.queries.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
