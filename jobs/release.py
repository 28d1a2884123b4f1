"""A release of a cross-ancestry meta-analysis: results by population and chromosome, with what was read, dropped and estimated.

One run makes one release: quality filters and the first of each variant by population, harmonised alleles, regressions, estimates.
All tables of a release are replaced by a run of the same name; other releases stay.
"""

from __future__ import annotations

import argparse
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, log_to_console, written
from xancestry.functions.expressions import z_score
from xancestry.operators import quality, regression
from xancestry.plans import meta, synth
from xancestry.schema import CHROMOSOMES, FREQUENCIES

DEFAULTS = {"release": "current", "populations": 2, "frequencies": list(FREQUENCIES), "chromosomes": list(CHROMOSOMES), "ld": None, "intercept": None, "se2": None, "standardised_units": False}
RESULT = "SNP string, BP long, A1 string, A2 string, FREQ double, BETA double, SE double, Z double, P string, N_EFF double, N_ORIG double, release string, population string, CHR string"
FIGURES = "population string, variants_in long, mean_chi_sq_in double, variants_out long, mean_chi_sq_out double"


def sources(spark: SparkSession, tables: str, populations: int) -> tuple[dict[tuple[str, str], DataFrame], DataFrame]:
    """Summary statistics of each population, and LD scores, from the tables under a path."""
    return {(f"R{i}", "T"): synth.sumstats(spark, tables, i) for i in range(populations)}, synth.ld_scores(spark, tables)


def figures(r: meta.Result) -> DataFrame:
    """Mean chi-squared of each population over its harmonised variants and over its results; one pass over each."""
    chi = lambda z, k: [meta.mean_chi_squared(x).alias(f"{k}{i}") for i, x in enumerate(z)]
    pops = range(len(r.tables))
    before = r.harmonised.agg(F.count("*").alias("variants_in"), *chi([F.col(f"p{i}.BETA") / F.col(f"p{i}.SE") for i in pops], "in_"))
    after = r.work.where("om_ok and si_ok").agg(F.count("*").alias("variants_out"), *chi([z_score(F.col("new_beta")[i], F.col("new_se")[i]) for i in pops], "out_"))
    each = [F.struct(F.lit("_".join(pop)).alias("population"), "variants_in", F.col(f"in_{i}").alias("mean_chi_sq_in"), "variants_out", F.col(f"out_{i}").alias("mean_chi_sq_out")) for i, pop in enumerate(r.tables)]
    return before.crossJoin(after).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def run(spark: SparkSession, sumstats: dict[tuple[str, str], object], ld_scores: list, out: str, given: dict | None = None, column_maps: dict | None = None) -> DataFrame:
    """Writes results/release=NAME (by population and chromosome), and drops, coefficients and figures of the release, under out;
    returns the results as they stand there, of all releases.

    sumstats and ld_scores are paths or DataFrames as in the meta-analysis. ld, intercept and se2 of the configuration are
    matrices of coefficients, or null where they are to be fitted.
    """
    c = DEFAULTS | (given or {})
    option = lambda x: regression.FREE if x is None else np.array(x, float)
    filters = quality.filters(tuple(c["frequencies"]), c["chromosomes"])
    r = meta.run(spark, sumstats, ld_scores, column_maps=column_maps, filters=filters, ld_option=option(c["ld"]), const_option=option(c["intercept"]), se2_option=option(c["se2"]), standardised_units=c["standardised_units"])
    try:
        of = f"release={c['release']}"
        drops = reduce(DataFrame.union, (k.metrics().select(F.lit("_".join(pop)).alias("population"), "filter", "dropped") for pop, k in r.checks.items()))
        drops = written(drops.coalesce(1), f"{out}/drops/{of}", "population string, filter string, dropped long")
        for row in drops.where("filter in ('ANY', 'TOTAL')").orderBy("population", "filter").collect():
            log.info("%s: %s %d", row["population"], "read" if row["filter"] == "TOTAL" else "filters drop", row["dropped"])
        names = [x.split()[0] for x in RESULT.split(", ") if not x.startswith("release ")]
        every = [t.withColumns({"population": F.lit("_".join(pop)), **{n: F.lit(None).cast("double") for n in ("N_EFF", "N_ORIG") if n not in t.columns}}).select(*names) for pop, t in r.tables.items()]
        # Sorted within a folder's files, which then can be read by position.
        rows = reduce(DataFrame.union, every).repartition("population", "CHR").sortWithinPartitions("population", "CHR", "BP", "SNP")
        written(rows, f"{out}/results/{of}", RESULT.replace("release string, ", ""), ("population", "CHR"))
        coefs = [(k, i, j, float(m[i, j])) for k, m in zip(("ld", "intercept", "se2"), r.coefficients) for i in range(len(m)) for j in range(len(m))]
        written(spark.createDataFrame(coefs, "kind string, i int, j int, value double").coalesce(1), f"{out}/coefficients/{of}", "kind string, i int, j int, value double")
        for row in written(figures(r).coalesce(1), f"{out}/figures/{of}", FIGURES).orderBy("population").collect():
            log.info("%s: mean chi-squared %s over %d variants, %s over %d results", *(row[k] for k in ("population", "mean_chi_sq_in", "variants_in", "mean_chi_sq_out", "variants_out")))
    finally:
        r.release()
    return spark.read.schema(RESULT).parquet(f"{out}/results")


def run_tables(spark: SparkSession, tables: str, out: str, given: dict | None = None) -> DataFrame:
    """A release from the tables under a path."""
    c = DEFAULTS | (given or {})
    pops, ld = sources(spark, tables, c["populations"])
    names = {x: x for x in ("SNP", "CHR", "BP", "A1", "A2", "FREQ", "BETA", "SE", "P", "N")}
    log.info("reading %d populations from %s", len(pops), tables)
    return run(spark, pops, [ld], out, c, dict.fromkeys(pops, names))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.release", description="a release of the meta-analysis")
    for x in ("config", "tables", "out"):
        p.add_argument(f"--{x}", required=True)
    a = p.parse_args(argv)
    log_to_console()
    c = config(a.config, DEFAULTS)
    spark = SparkSession.builder.appName("release").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run_tables(spark, a.tables, a.out, c)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
