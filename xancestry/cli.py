"""Command lines: python -m xancestry.cli meta ... and python -m xancestry.cli ldscores ..."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from .operators import columns, quality, regression
from .plans import ld, meta, sinks
from .schema import CHROMOSOMES, FREQUENCIES, PATTERNS, REQUIRED
from .sources import plink, text


def _source(s: str) -> tuple[str, str, str]:
    parts = s.rsplit(",", 2)
    if len(parts) != 3 or not all(parts):
        raise argparse.ArgumentTypeError(f"FILE,ANCESTRY,PHENOTYPE is needed, not {s}")
    return tuple(parts)


def _correlation(s: str) -> float:
    x = float(s)
    if not -1 <= x <= 1:
        raise argparse.ArgumentTypeError("a correlation is from -1 to 1")
    return x


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="xancestry")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("meta", help="meta-analysis of summary statistics")
    m.add_argument("--sumstats", type=_source, nargs="+", required=True, metavar="FILE,ANCESTRY,PHENOTYPE")
    m.add_argument("--ld-scores", nargs="+", required=True, metavar="PATTERN")
    m.add_argument("--snp-list")
    m.add_argument("--out", required=True, type=sinks.output_prefix)
    m.add_argument("--out-reg-coef", action="store_true")
    m.add_argument("--out-harmonized", action="store_true")
    m.add_argument("--use-standardized-units", action="store_true")
    m.add_argument("--input-sep")
    loud = m.add_mutually_exclusive_group()
    loud.add_argument("--quiet", action="store_true")
    loud.add_argument("--verbose", action="store_true")
    g = m.add_mutually_exclusive_group()
    g.add_argument("--reg-ld-coef", metavar="FILE")
    g.add_argument("--reg-ld-set-corr", type=_correlation)
    g.add_argument("--reg-ld-unc", action="store_true")
    g = m.add_mutually_exclusive_group()
    g.add_argument("--reg-se2-coef", metavar="FILE")
    for x in ("zero", "ident", "diag", "unc"):
        g.add_argument(f"--reg-se2-{x}", action="store_true")
    g = m.add_mutually_exclusive_group()
    g.add_argument("--reg-int-coef", metavar="FILE")
    for x in ("zero", "diag", "unc"):
        g.add_argument(f"--reg-int-{x}", action="store_true")
    m.add_argument("--freq-bounds", type=float, nargs=2, default=FREQUENCIES)
    m.add_argument("--allowed-chr-values", nargs="+", default=CHROMOSOMES)
    m.add_argument("--allow-palindromic-snps", action="store_true")
    for c in PATTERNS:
        g = m.add_mutually_exclusive_group()
        g.add_argument(f"--add-{c.lower()}-col-match", metavar="REGEX")
        g.add_argument(f"--replace-{c.lower()}-col-match", metavar="REGEX")
    s = sub.add_parser("ldscores", help="LD scores from genotypes")
    s.add_argument("--out", required=True, type=sinks.output_prefix)
    s.add_argument("--stream-stdout", action="store_true", help="the log on the console too")
    s.add_argument("--bfile-merged-path", required=True)
    s.add_argument("--ances-path", required=True)
    s.add_argument("--snp-ances", required=True)
    s.add_argument("--no-single-correct", action="store_true")
    s.add_argument("--std-geno-ldsc", action="store_true")
    s.add_argument("--symmetric", action="store_true", help="the other variant's ratio on both sides")
    s.add_argument("--ld-extract", metavar="FILE")
    s.add_argument("--ld-keep", metavar="FILE")
    for x in ("snps", "kb", "cm"):
        s.add_argument(f"--ld-wind-{x}", type=float)
    s.add_argument("--print-snps", metavar="FILE")
    s.add_argument("--print-cross-only", action="store_true")
    s.add_argument("--chunk-size", type=int, default=50)
    s.add_argument("--pq-exp", type=float, default=0.0)
    s.add_argument("--maf", type=float, default=0.0)
    s.add_argument("--ldBlockSize", action="store_true")
    return top


def options(a: argparse.Namespace, n: int) -> dict:
    """The three regressions' options; on the command line SE^2 has no free off-diagonals unless asked for."""
    read = lambda f: text.matrix(f, n)
    return {
        "ld_option": read(a.reg_ld_coef) if a.reg_ld_coef else regression.SET_CORR if a.reg_ld_set_corr is not None else regression.FREE,
        "correlation": a.reg_ld_set_corr if a.reg_ld_set_corr is not None else 1.0,
        "se2_option": read(a.reg_se2_coef) if a.reg_se2_coef else regression.ZERO if a.reg_se2_zero else regression.IDENTITY if a.reg_se2_ident else regression.FREE if a.reg_se2_unc else regression.OFF_ZERO,
        "const_option": read(a.reg_int_coef) if a.reg_int_coef else regression.ZERO if a.reg_int_zero else regression.OFF_ZERO if a.reg_int_diag else regression.FREE,
    }


def run_meta(spark: SparkSession, a: argparse.Namespace, log) -> None:
    sumstats = {(anc, phen): path for path, anc, phen in a.sumstats}
    if len(sumstats) < len(a.sumstats):
        raise ValueError("an ancestry and phenotype is given twice")
    lds = [f for p in a.ld_scores for f in text.expand(spark, p)]
    of = lambda kind: {c: v for c in PATTERNS if (v := getattr(a, f"{kind}_{c.lower()}_col_match"))}
    by = columns.patterns(of("add"), of("replace"))
    anc = [x for x, _ in sumstats]
    for f in lds:
        names = text.header(spark, f)
        for x in anc:
            for y in anc:
                from .operators.harmonise import ld_column

                ld_column(names, x, y)
    maps = {pop: columns.map_columns(text.header(spark, f, a.input_sep), by, REQUIRED) for pop, f in sumstats.items()}
    fs = quality.filters(tuple(a.freq_bounds), a.allowed_chr_values, a.allow_palindromic_snps)
    r = meta.run(spark, sumstats, lds, a.snp_list, maps, by, fs, standardised_units=a.use_standardized_units, sep=a.input_sep, **options(a, len(sumstats)))
    for pop, ck in r.checks.items():
        log.info("%s: %s", pop, {x["filter"]: x["dropped"] for x in ck.metrics().collect()})
        if log.isEnabledFor(logging.DEBUG):
            for name in (n for n, c in ck.flags.items() if c):
                log.debug("%s: %s drops %s", pop, name, ck.dropped(name))
            log.debug("%s: duplicates %s", pop, ck.repeated())
    log.info("matrices: %s", r.counts())
    for pop, (before, after) in r.mean_chi_sq().items():
        log.info("%s: mean chi-squared %s before, %s after", pop, before, after)
    for i, ((x, y), t) in enumerate(r.tables.items()):
        sinks.write_results(t, f"{a.out}_{x}_{y}.res")
        if a.out_harmonized:
            sinks.write_harmonised(r.harmonised, i, r.has_n[i], f"{a.out}_{x}_{y}.hrm", "INFO" in r.checks[x, y].passed.columns)
    if a.out_reg_coef:
        for name, m in zip(("ld", "int", "se2"), r.coefficients):
            sinks.write_coefficients(m, f"{a.out}_{name}_reg.cf")


def run_ld(spark: SparkSession, a: argparse.Namespace, log) -> None:
    variants, people = plink.bim(spark, f"{a.bfile_merged_path}.bim"), plink.fam(spark, f"{a.bfile_merged_path}.fam")
    n_people, n_variants = people.count(), variants.count()
    people = ld.checked(people, plink.ancestry_map(spark, a.ances_path))
    kept = None
    if a.ld_extract:
        variants = ld.matching(variants, text.one_column(spark, a.ld_extract), "SNP", a.ld_extract)
    if a.ld_keep:
        people = ld.matching(people, text.one_column(spark, a.ld_keep).withColumnRenamed("SNP", "IID"), "IID", a.ld_keep)
        kept = [r["ind_idx"] for r in people.select("ind_idx").orderBy("ind_idx").collect()]
    geno = plink.bed(spark, f"{a.bfile_merged_path}.bed", n_people, n_variants, kept)
    print_snps = text.one_column(spark, a.print_snps) if a.print_snps else None
    sources = text.scan(spark, a.snp_ances, r"\s+").drop("place")
    reach = ld.window(a.ld_wind_snps, a.ld_wind_kb, a.ld_wind_cm)
    scores, counts = ld.estimate(spark, variants, people, geno, sources, reach, a.chunk_size, a.maf, not a.std_geno_ldsc, not a.no_single_correct, a.symmetric, a.pq_exp, a.ldBlockSize)
    for pair, n in ld.zero_scores(scores).items():
        log.warning("%s: %d variants have an LD score of zero, as those without variation have", pair, n)
    scores = ld.restrict(scores, print_snps, a.print_cross_only)
    sinks.write_ldscores(scores, a.out)
    sinks.write_counts(counts, a.out)


def chosen(argv: list[str], a: argparse.Namespace) -> dict[str, object]:
    """The options that stand on the command line, whole or cut short, with their values."""
    given = [x[2:].split("=")[0].replace("-", "_") for x in argv if x.startswith("--")]
    return {k: v for k, v in vars(a).items() if k != "command" and any(k == g or k.startswith(g) and g not in vars(a) for g in given)}


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    log = sinks.logger(f"{a.out}.log", 40 if getattr(a, "quiet", False) else 10 if getattr(a, "verbose", False) else 20, getattr(a, "stream_stdout", True))
    log.info("xancestry %s", " ".join(argv))
    set_by_user = chosen(argv, a)
    for kind, options_ in (("set", set_by_user), ("default", {k: v for k, v in vars(a).items() if k != "command" and k not in set_by_user and v not in (None, False)})):
        for k, v in options_.items():
            log.log(logging.INFO if kind == "set" else logging.DEBUG, "%s: %s = %s", kind, k, v)
    began = time.time()
    spark = SparkSession.builder.appName("xancestry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    try:
        (run_meta if a.command == "meta" else run_ld)(spark, a, log)
    except Exception as e:
        log.error("%s", e)
        return 1
    log.info("took %s", sinks.elapsed(time.time() - began))
    return 0


if __name__ == "__main__":
    sys.exit(main())
