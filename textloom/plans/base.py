"""How plans are written down: a name, a function of (spark, sf_dir), and SQL where SQL states it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass
class Plans:
    queries: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None):
        def keep(f: Plan) -> Plan:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A table of few parts for the cores there are, dealt out: work that is heavy for its bytes then runs on all of them.

    A part of a file need not hold rows (a file of one row group has them all in one part),
    so that parts count only where there are several a core; such a table is large, and left alone.
    """
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < 2 * n else df
