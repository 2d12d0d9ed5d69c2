"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised forecast windows, split in time: scan, daily frames, validity, split, train moments, gather."""
    return q.q_window_tensors(spark, sf_dir)
