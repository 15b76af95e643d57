"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotweave.plans import sqltext as Q
from shotweave.plans.flagship import flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


register("flagship_upsample_fidelity", Q.FLAGSHIP_SQL)(lambda spark, sf: flagship(spark, sf, k=Q.K))

# Query groups register themselves on import.
from shotweave.plans import q_labels  # noqa: E402,F401
from shotweave.plans import q_metrics  # noqa: E402,F401
from shotweave.plans import q_augment, q_eda, q_mix, q_score, q_assemble, q_results, q_review, q_io  # noqa: E402,F401
