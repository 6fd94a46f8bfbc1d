"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from .plans import boxes, causes, decomposition, detection, documents, files, profiles, records, tables

MODULES = (detection, decomposition, boxes, tables, causes, documents, records, files, profiles)


def flagship(spark, sf_dir: str):
    return detection.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
