"""The meta-analysis: from one table a population to one result a population."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import effective_n, log10_p, p_text, unit_scale, z_score
from ..operators import columns, gls, harmonise, quality, regression
from ..sources import text
from .planning import kept

log = logging.getLogger(__name__)


@dataclass
class Result:
    """Per population (ancestry, phenotype) a DataFrame; coefficients; harmonised rows; what was dropped and changed."""

    tables: dict[tuple[str, str], DataFrame]
    coefficients: tuple[np.ndarray, np.ndarray, np.ndarray]
    harmonised: DataFrame
    has_n: list[bool]
    work: DataFrame
    checks: dict[tuple[str, str], quality.Checked] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """What the results read needn't be kept any more."""
        for df in self.held:
            df.unpersist()

    def counts(self) -> dict[str, int]:
        """Variants that were adjusted or dropped by the checks of their matrices."""
        return self.work.agg(F.count("*").alias("variants"), F.count_if("om_tweaked").alias("tweaked"), F.count_if(~F.col("om_ok")).alias("omega_dropped"), F.count_if(~F.col("si_ok")).alias("sigma_dropped"), F.count_if(~(F.col("om_ok") & F.col("si_ok"))).alias("dropped")).first().asDict()

    def mean_chi_sq(self) -> dict[tuple[str, str], tuple[float | None, float | None]]:
        """By population, before and after: over its harmonised variants, and over those whose matrices pass; one pass over each."""
        pops = list(self.tables)
        before = self.harmonised.agg(*(mean_chi_squared(F.col(f"p{i}.BETA") / F.col(f"p{i}.SE")).alias(f"m{i}") for i in range(len(pops)))).first()
        after = self.work.where("om_ok and si_ok").agg(*(mean_chi_squared(F.col("new_beta")[i] / F.col("new_se")[i]).alias(f"m{i}") for i in range(len(pops)))).first()
        return {pop: (before[i], after[i]) for i, pop in enumerate(pops)}

    def mean_omega(self) -> np.ndarray:
        return mean_matrix(self.work, "om")

    def mean_sigma(self) -> np.ndarray:
        return mean_matrix(self.work, "sigma")


def mean_matrix(df: DataFrame, c: str) -> np.ndarray:
    got = df.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()
    n = int(len(got) ** 0.5)
    return np.array([r["x"] for r in got]).reshape(n, n) if n else np.zeros((0, 0))


def mean_chi_squared(z):
    return F.avg(z * z)


def ingest(spark: SparkSession, source, by=None, names=None, filters=None, optional=None, sep=None) -> quality.Checked:
    df = columns.standardise(text.obtain(spark, source, sep), by, names)
    return quality.qc_sumstats(df, filters, optional)


def read_ld(spark: SparkSession, sources, sep=None) -> DataFrame:
    return quality.qc_ldscores(text.union([text.obtain(spark, s, sep) for s in sources]).drop("place"))


def in_units(beta_or_se, freq):
    return beta_or_se * unit_scale(freq)


def run(
    spark: SparkSession,
    sumstats: dict[tuple[str, str], object],
    ld_scores: list,
    snp_list: DataFrame | str | None = None,
    column_maps: dict | None = None,
    patterns: dict[str, str] | None = None,
    filters: dict | None = None,
    ld_option=regression.FREE,
    se2_option=regression.FREE,
    const_option=regression.FREE,
    correlation: float = 1.0,
    standardised_units: bool = False,
    sep: str | None = None,
) -> Result:
    """Populations in the order given; the first is the one whose alleles all others are turned to."""
    pops = list(sumstats)
    n, anc = len(pops), [a for a, _ in pops]
    # Read by the check and by the join.
    ld = kept(read_ld(spark, ld_scores, sep))
    if twice := ld.groupBy("SNP").count().where("count > 1").limit(1).count():
        raise ValueError(f"LD scores have {twice and 'a variant more than once'}")
    keep = text.ids(spark, snp_list) if isinstance(snp_list, str) else snp_list
    checks = {pop: ingest(spark, src, patterns, (column_maps or {}).get(pop), filters, None, sep) for pop, src in sumstats.items()}
    h, _ = harmonise.harmonise([c.passed for c in checks.values()], ld, keep)
    # Read twice, by the regressions and by the estimator; partitions that are lost are made again.
    h = kept(h)
    c = harmonise.collate(h, anc)
    if standardised_units:
        scale = lambda x: F.array(*(in_units(F.col(x)[i], F.col(f"p{i}.FREQ")) for i in range(n)))
        c = c.withColumns({"beta": scale("beta"), "se": scale("se")})
    coef = regression.ldscore_regressions(c, n, ld_option, const_option, se2_option, correlation)
    work = c.withColumns({"omega": gls.omega(F.col("ld"), coef[0]), "sigma": gls.sigma(F.col("se"), coef[2], coef[1])})
    # Read by every population's table and by all figures: the estimator runs once.
    work = kept(gls.gls(work, n))
    has_n = ["N" in ck.passed.columns for ck in checks.values()]
    tables = {pop: result_table(work, i, n, has_n[i], standardised_units) for i, pop in enumerate(pops)}
    return Result(tables, coef, h, has_n, work, checks, [ld, h, work])


def result_table(work: DataFrame, i: int, n: int, has_n: bool, standardised_units: bool = False) -> DataFrame:
    """One population's rows that passed all checks. Z, P and N_EFF are in the units that the estimator worked in."""
    p, b, s = F.col(f"p{i}"), F.col("new_beta")[i], F.col("new_se")[i]
    d = work.where("om_ok and si_ok").withColumn("z_", z_score(b, s)).withColumn("lp_", log10_p(F.col("z_")))
    back = 1 / unit_scale(p["FREQ"]) if standardised_units else F.lit(1.0)
    out = [F.col("SNP"), p["CHR"].alias("CHR"), p["BP"].alias("BP"), p["A1"].alias("A1"), p["A2"].alias("A2"), p["FREQ"].alias("FREQ"), (b * back).alias("BETA"), (s * back).alias("SE"), F.col("z_").alias("Z"), p_text(F.col("lp_")).alias("P")]
    if has_n:
        out += [effective_n(p["N"], F.col("sigma")[i * n + i], s).alias("N_EFF"), p["N"].alias("N_ORIG")]
    return d.select(*out)
