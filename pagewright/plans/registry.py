"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import census, checkpoints, checks, decoders, delta, evidence, files, search, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _module in (census, decoders, delta, checkpoints, search, snapshots, evidence, checks, files):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
