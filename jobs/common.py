"""What the jobs share: configuration, logs, and tables at paths."""

from __future__ import annotations

import json
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(path: str, known: dict) -> dict:
    """A job's defaults with what its file says; a key that the job doesn't know is an error."""
    with open(path) as f:
        given = json.load(f)
    if unknown := set(given) - set(known):
        raise ValueError(f"{path} has unknown keys {sorted(unknown)}")
    return known | given


def log_to_console() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at a path, partition columns with the types that the schema gives them; None if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def written(df: DataFrame, path: str, schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Replaces the table at path by df, in folders by these columns; logs and returns what stands there now."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    log.info("wrote %d rows to %s%s", out.count(), path, f" by {', '.join(by)}" if by else "")
    return out
