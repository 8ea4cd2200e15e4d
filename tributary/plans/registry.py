"""Queries of the engine and their SQL oracles, by inventory id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.plans import q_engine, q_findings, q_more, q_store
from tributary.plans.base import ORACLES, QUERIES

MODULES = (q_findings, q_store, q_engine, q_more)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_engine.flagship(spark, sf_dir)
