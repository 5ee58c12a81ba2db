"""Registered queries of the reference's operators with their SQL oracles."""

from __future__ import annotations

from tidemark.queries import long, matrices, more, series, tables

QUERIES: dict = series.QUERIES | matrices.QUERIES | tables.QUERIES | more.QUERIES | long.QUERIES
ORACLES: dict = series.ORACLES | matrices.ORACLES | tables.ORACLES | more.ORACLES | long.ORACLES
