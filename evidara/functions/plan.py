"""Ways around faults of the planner, and settings that hold for one action."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def steady_unions(spark: SparkSession) -> None:
    """Keep unions from claiming their children's partitioning.

    Spark 4.1 plans a union of equally partitioned children without a shuffle above it, but
    adaptive execution may still change a child's partitions; then rows of one key end in several
    tasks, and groups or joins above come out wrong or fail ("Can't zip RDDs").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    steady_unions(a.sparkSession)
    return a.unionByName(b)


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions inside send their Python functions Arrow batches of about ``most`` bytes at most, and one row at least."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
