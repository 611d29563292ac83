"""All registered queries over the base tables, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolesieve.plans import views

FLAGSHIP = "search"
for _m in ("text", "organisation", "policy", "retrieval", "conversation", "operations"):
    importlib.import_module(f"rolesieve.plans.{_m}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(views.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(views.SQL)
