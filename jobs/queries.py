"""The jobs as queries over the driver's tables: each runs twice into one new folder, and returns what stands there then."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import release, term_association
from jobs.common import config
from xancestry import queries as core

HERE = os.path.dirname(os.path.abspath(__file__))


def _folder(spark: SparkSession, job: str) -> str:
    """A new folder in the shared one that the cluster names; one of its own only where none is named, on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = "/tmp/checkpoints/xancestry"
    return f"{at.rstrip('/')}/{job}-{uuid.uuid4().hex}"


def job1_term_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no file that is new."""
    at, c = _folder(spark, "job1"), config(f"{HERE}/term_association.json", term_association.DEFAULTS)
    for _ in range(2):
        out = term_association.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{at}/out", f"{at}/checkpoint", c)
    return out.select("cohort", "SNP", "CARRIERS", "N", *core._r("FREQ", "BETA", "SE"), (F.round("Z", 6) + F.lit(0.0)).alias("Z"), *core._p_columns(F.col("P")))


def job2_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, c = _folder(spark, "job2"), config(f"{HERE}/release.json", release.DEFAULTS)
    for _ in range(2):
        out = release.run_tables(spark, sf_dir, f"{at}/out", c)
    return out.select("release", "population", "CHR", "SNP", "BP", "A1", "A2", *core._r("FREQ", "SE", "N_EFF"), *core._r_scaled("BETA", "Z"), *core._p_columns(F.col("P")))


JOB1_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'unnamed' ELSE source END AS cohort,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{term_association.UPPER}', '{term_association.LOWER}'), '{term_association.WORD}')) AS words
  FROM documents),
y AS (SELECT doc_id, min(quality) AS y FROM labels GROUP BY doc_id HAVING min(quality) IN (0, 1)),
o AS (SELECT cohort, words, y FROM d JOIN y USING (doc_id)),
t AS (SELECT cohort, count(*) AS n, sum(y) AS s FROM o GROUP BY cohort),
w AS (SELECT cohort, y, unnest(words) AS SNP FROM o),
c AS (SELECT cohort, SNP, count(*) AS n1, sum(y) AS s1, n - count(*) AS n0, s - sum(y) AS s0, n FROM w JOIN t USING (cohort) GROUP BY cohort, SNP, n, s),
a AS (
  SELECT cohort, SNP, n1 AS CARRIERS, n::DOUBLE AS N, n1::DOUBLE / n AS FREQ, s1::DOUBLE / n1 - s0::DOUBLE / n0 AS BETA,
         sqrt(((s1 * (n1 - s1))::DOUBLE / n1 + (s0 * (n0 - s0))::DOUBLE / n0) / (n - 2) * n / (n1 * n0)) AS SE
  FROM c WHERE n > 2 AND n0 > 0),
p AS (SELECT *, BETA / SE AS z FROM a WHERE FREQ BETWEEN 0.01 AND 0.99 AND SE > 0 AND CARRIERS >= 3)
SELECT cohort, SNP, CARRIERS::BIGINT AS CARRIERS, N, {core._rs("FREQ", "BETA", "SE")}, round(z, 6) + 0 AS Z, {core._P_SQL} FROM (SELECT *, {core._log10_tail_sql("z")} AS lp FROM p)"""

JOB2_SQL = (
    f"{core.MILD}, {core._eliminated(2)}, two AS ("
    + " UNION ALL ".join(f"SELECT 'R{p}_T' AS population, SNP, CHR{p} AS CHR, BP{p} AS BP, A1_{p} AS A1, A2_{p} AS A2, f{p} AS FREQ, t / u AS BETA, 1 / sqrt(u) AS SE, t / sqrt(u) AS z, n{p} * g{p}{p} * u AS N_EFF FROM x JOIN est USING (SNP) WHERE p = {p}" for p in (0, 1))
    + f") SELECT 'current' AS release, population, SNP, CHR, BP, A1, A2, {core._rs('FREQ', 'SE', 'N_EFF')}, round(BETA, 6) + 0 AS BETA, round(z, 6) + 0 AS Z, {core._P_SQL} FROM (SELECT *, {core._log10_tail_sql('z')} AS lp FROM two)"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_term_association, job2_release)}


def oracle_sql() -> dict[str, str]:
    return {"job1_term_association": JOB1_SQL, "job2_release": JOB2_SQL}
