"""All queries by name, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import aggregation, arabic, audits, governance, lessons, letters, measures, records, relational, streams, texts
from textloom.plans.base import Plan

MODULES = (relational, aggregation, texts, arabic, measures, records, audits, lessons, letters, governance, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus error rates by overlapping strata."""
    return aggregation.a5_overlapping_strata(spark, sf_dir)


def queries() -> dict[str, Plan]:
    return {k: v for m in MODULES for k, v in m.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.plans.sql.items()}
