"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpusloom.llm as _package

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    for m in pkgutil.iter_modules(_package.__path__):
        if m.name != "queries":
            yield importlib.import_module(f"{_package.__name__}.{m.name}")


def queries() -> dict[str, Query]:
    """The functions named op<N>_<name> of this subpackage's modules, by N."""
    found = {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and k[2:].split("_")[0].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express: ORACLE of each module."""
    return {k: v for m in _modules() for k, v in getattr(m, "ORACLE", {}).items()}
