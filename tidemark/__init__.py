"""Interval-valid one-to-many dictionaries as Spark DataFrames."""

from tidemark.dictionary import TemporalMap
from tidemark.domain import DATE, DOUBLE, INT, TIMESTAMP, Domain

__all__ = ["DATE", "DOUBLE", "Domain", "INT", "TIMESTAMP", "TemporalMap"]
