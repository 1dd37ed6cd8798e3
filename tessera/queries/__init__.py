"""Queries over the driver's tables, one for each operator, with their SQL counterparts."""

from tessera.queries import dense, graph, labels, linalg, random, sparse, stats  # noqa: F401
