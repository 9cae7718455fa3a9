"""Registered queries of the engine and their SQL twins."""

from ..registry import ORACLES, QUERIES
from . import corpus, datasets, kb, metrics, relational, retrieval, structure

__all__ = ["ORACLES", "QUERIES", "corpus", "datasets", "kb", "metrics", "relational", "retrieval", "structure"]
