"""Operators for training-data pipelines: deduplication, scoring, scanning, mixing, extraction, sharding, packing, search."""

from tabloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
