"""Settings for plans that are planned here and kept."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def _set(spark, key, value):
    """A setting that the session leaves to Spark's default (None here) is left to it again: null can't be set."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def without_constraints(spark):
    """Plans of many joined populations, each behind the same filters, take long to plan if every filter is carried on."""
    return _set(spark, CONSTRAINTS, "false")


def shuffled_in(spark, parts: int):
    """Plans that are made within shuffle into so many partitions."""
    return _set(spark, PARTITIONS, str(parts))


def kept(df: DataFrame) -> DataFrame:
    """df persisted, and planned at once; partitions that are lost are made again from its lineage."""
    with without_constraints(df.sparkSession):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
