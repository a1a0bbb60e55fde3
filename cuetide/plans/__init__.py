"""Queries over the operators."""

from . import cleaning, evaluation, evidence, queries, regions, review, stores, streams  # noqa: F401  (each adds its queries to the registry)
