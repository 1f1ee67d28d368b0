"""Registered queries of the media operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.registry import capture, live, shapes, uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (uploads, capture, shapes, live):
    QUERIES |= _module.QUERIES
    ORACLES |= {k: v for k, v in _module.ORACLES.items() if v}
