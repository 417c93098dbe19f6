"""Registered queries over the given tables. Importing this package registers all of them."""

from quarry.plans.registry import ORACLES, QUERIES

from quarry.plans import chat, corpus, files, finance, io, joins, scores, structured  # noqa: E402, F401  isort: skip

__all__ = ["ORACLES", "QUERIES"]
