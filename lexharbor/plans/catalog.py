"""All queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import REGISTRY


def _load() -> None:
    from . import corpus, lexicons, sampling, statistics, textual  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: f for n, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: s for n, (_, s) in REGISTRY.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["yearly_yield"](spark, sf_dir)
