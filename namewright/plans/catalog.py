"""Imports every module of queries; QUERIES and ORACLES are complete here."""

from namewright.plans import aggregates, flagship, learned, pairs, relational, scans, texts, windows  # noqa: F401
from namewright.plans.registry import ORACLES, QUERIES  # noqa: F401
