"""The registered queries over the given tables."""

from . import catalogue, linkage, sequences, similarity
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "linkage", "sequences", "similarity"]
