"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    auditing, collection, consolidation, evaluation, extraction, models, preparation, scalars, splitting,
)
from .registry import REGISTRY


def queries():
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in REGISTRY.items() if query.sql}
