"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import plans
from .plans import registry

for _module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
