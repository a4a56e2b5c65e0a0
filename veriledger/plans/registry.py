"""All queries of the analytics operators by name, with their DuckDB twins."""

from __future__ import annotations

from . import evaluation, forms, grounded, intake, norm, recon, retrieval, rules, service, subjects  # noqa: F401  these register their queries
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
