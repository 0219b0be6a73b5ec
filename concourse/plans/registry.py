"""The table of registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "scans",
    "filters",
    "joins",
    "spatial_joins",
    "aggregates",
    "windows",
    "linear",
    "ordering",
    "directory",
    "network",
    "walks",
    "contract_rules",
    "reports",
)


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Column-pruned access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its SQL text."""

    def wrap(fn):
        if key in REGISTRY:
            raise ValueError(f"query registered twice: {key}")
        REGISTRY[key] = Query(key, lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"concourse.plans.{module}")
    return REGISTRY
