"""LD scores from genotype files: by pair of ancestries, over the variants that both have."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ldscore, numbering
from .planning import kept

SIZES = "_ldBlockSize"
#: Variants that are numbered in one task.
NUMBERED = 1 << 17


def window(snps: float | None = None, kb: float | None = None, cm: float | None = None) -> tuple[float, str]:
    """(distance, column); exactly one unit has to be given. None stands for the place in the file."""
    given = [(float(x) * times, c) for x, times, c in ((snps, 1, "idx"), (kb, 1000, "BP"), (cm, 1, "CM")) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of snps, kb and cm is needed")
    return given[0]


def checked(people: DataFrame, ancestries: DataFrame) -> DataFrame:
    """people with their ancestry; one without is an error."""
    if missing := people.join(ancestries, "IID", "left_anti").limit(5).collect():
        raise ValueError(f"no ancestry for {[r['IID'] for r in missing]}")
    return people.join(ancestries, "IID")


@dataclass
class Counted:
    """Variants that may have a score, and how many of them each pair of ancestries has; what scores() reads.

    anc: ancestries in order; of: each person's; rows: variants with has_0, has_1, ..., ok_all, and ok and common by pair; found: by pair the
    variants that both have, and of these the common ones.
    """

    anc: list[str]
    of: np.ndarray
    rows: DataFrame
    geno: DataFrame
    found: list[tuple[int, int]]

    def pairs(self) -> list[tuple[int, int]]:
        return _pairs(self.anc)

    def counts(self) -> DataFrame:
        rows = [(self.anc[a], self.anc[b], *n) for (a, b), n in zip(self.pairs(), self.found)]
        return self.rows.sparkSession.createDataFrame(rows, "anc1 string, anc2 string, m long, m_5_50 long")

    def scores(self, reach: tuple[float, str], chunk: int = 50, per_allele: bool = True, correct: bool = True, symmetric: bool = False, exponent: float = 0.0, sizes: bool = False) -> DataFrame:
        """CHR, SNP, BP and a column a pair of ancestries. All pairs are numbered, put in windows and scored together."""
        combos, out = self.pairs(), self.rows.where("ok_all").select("snp_idx", "CHR", "SNP", "BP")
        if not any(m for m, _ in self.found):
            return out
        start = [sum(m for m, _ in self.found[:at]) for at in range(len(combos))]
        first = F.element_at(F.array(*(F.lit(x).cast("long") for x in start)), F.col("pair") + 1)
        tagged = self.rows.select("snp_idx", "BP", "CM", F.explode(F.array(*(F.when(x, F.lit(at)) for at, x in enumerate(_own(combos))))).alias("pair")).where("pair is not null")
        # Pair by pair, from the sum of the counts before.
        number = kept(numbering.dense(tagged, [F.col("pair"), F.floor(F.col("snp_idx") / NUMBERED)], [F.col("snp_idx")], "place"))
        x = F.col("place") if reach[1] == "idx" else F.col(reach[1])
        near = numbering.bounds(number.select(F.col("place").alias("idx"), x.cast("double").alias("x"), "pair"), reach[0], by="pair")
        near = kept(near.join(number.select(F.col("place").alias("idx"), "pair", "snp_idx"), "idx").select("pair", "snp_idx", (F.col("idx") - first).alias("idx"), (F.col("left") - first).alias("left"), "size"))
        people = {at: (self.of == self.anc[a], self.of == self.anc[b]) for at, (a, b) in enumerate(combos)}
        own = near.groupBy("snp_idx").agg(F.collect_list(F.struct("pair", "idx")).alias("at"))
        scored = ldscore.scores(self.geno.join(own, "snp_idx").select("at", "dosage"), people, near.select("pair", "idx", "left"), chunk, per_allele, correct, symmetric, exponent)
        scored = scored.join(near, ["pair", "idx"])
        columns = []
        for at, (a, b) in enumerate(combos):
            if self.found[at][0]:
                name, of_pair = f"{self.anc[a]}_{self.anc[b]}", F.col("pair") == at
                columns.append(F.max(F.when(of_pair, F.nullif("l2", F.lit(0.0)))).alias(name))
                if sizes:
                    columns.append(F.max(F.when(of_pair, F.col("size").cast("double"))).alias(name + SIZES))
        out = out.join(scored.groupBy("snp_idx").agg(*columns), "snp_idx", "left")
        order = [f"{self.anc[a]}_{self.anc[b]}" for a, b in combos if a != b] + [f"{x}_{x}" for x in self.anc]
        order += [c + SIZES for c in order]
        return out.select("snp_idx", "CHR", "SNP", "BP", *(c for c in order if c in out.columns))


def _pairs(anc: list[str]) -> list[tuple[int, int]]:
    return list(itertools.combinations_with_replacement(range(len(anc)), 2))


def _own(combos: list[tuple[int, int]]) -> list[Column]:
    """By pair of ancestries, whether both have a variant and it passes the genotype filter over their people."""
    return [(F.col(f"has_{a}") != 0) & (F.col(f"has_{b}") != 0) & F.col("ok")[at] for at, (a, b) in enumerate(combos)]


def counted(variants: DataFrame, people: DataFrame, geno: DataFrame, sources: DataFrame, maf: float = 0.0) -> Counted:
    """variants: snp_idx, CHR, SNP, CM, BP. people: ind_idx, ancestry. geno: snp_idx, dosage. sources: SNP and 0 or 1 by
    ancestry. Variants without a source are left out, as are those that fail the genotype filter over all people. People's
    ancestries come to the driver, and of variants their numbers only.
    """
    of = np.array([r["ancestry"] for r in people.select("ind_idx", "ancestry").orderBy("ind_idx").collect()])
    anc = sorted({str(a) for a in of})
    known = variants.join(sources, "SNP")
    flags = geno.select("snp_idx", F.col("dosage").cast("array<int>").alias("dosage")).mapInArrow(_genotype_checks(of, anc, maf), "snp_idx long, ok_all boolean, ok array<boolean>, common array<boolean>")
    # Read by the counts and the scores; partitions that are lost are made again.
    rows = kept(known.join(flags, "snp_idx").select("snp_idx", "CHR", "SNP", "BP", "CM", *(F.col(a).cast("double").alias(f"has_{k}") for k, a in enumerate(anc)), "ok_all", "ok", "common"))
    own = _own(_pairs(anc))
    found = rows.agg(F.count("*"), *(F.count_if(x) for x in own), *(F.count_if(x & F.col("common")[at]) for at, x in enumerate(own))).first()[1:]
    return Counted(anc, of, rows, geno, list(zip(found[: len(own)], found[len(own) :])))


def estimate(spark: SparkSession, variants: DataFrame, people: DataFrame, geno: DataFrame, sources: DataFrame, reach: tuple[float, str], chunk: int = 50, maf: float = 0.0, per_allele: bool = True, correct: bool = True, symmetric: bool = False, exponent: float = 0.0, sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, counts): CHR, SNP, BP and a column a pair of ancestries; and anc1, anc2, m, m_5_50. Tables are those of counted().

    A zero score is written as null. With sizes, columns named after a pair with SIZES tell how many of its variants are nearer than reach.
    """
    c = counted(variants, people, geno, sources, maf)
    return c.scores(reach, chunk, per_allele, correct, symmetric, exponent, sizes), c.counts()


def _genotype_checks(of, anc, maf):
    combos = list(itertools.combinations_with_replacement(range(len(anc)), 2))
    masks = [(of == anc[a]) | (of == anc[b]) for a, b in combos]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            step = max(1, ldscore.AT_ONCE // max(1, len(of)))
            flat = pc.fill_null(batch.column(1).flatten(), -1).to_numpy(zero_copy_only=False).reshape(n, -1) if n else None
            for at in range(0, n, step):
                g = flat[at : at + step].astype(float)
                g[g < 0] = np.nan
                ok, common = [], []
                for mask in masks:
                    own = g[:, mask]
                    ok.append(ldscore.maf_ok(own, maf))
                    common.append(ldscore.smaller_frequency(own) > 0.05)
                lists = lambda x: pa.array(np.array(x).T.tolist(), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), pa.array(ldscore.maf_ok(g, maf)), lists(ok), lists(common)], ["snp_idx", "ok_all", "ok", "common"])

    return run


def matching(df: DataFrame, wanted: DataFrame, key: str, what: str) -> DataFrame:
    """Rows of a list of ids; a list that no row matches is an error."""
    out = df.join(wanted, key, "left_semi")
    if out.isEmpty():
        raise ValueError(f"nothing matches {what}")
    return out


def zero_scores(scores: DataFrame) -> dict[str, int]:
    """How many variants have no score, of pairs of ancestries that have such: zero is written as null."""
    names = [c for c, t in scores.dtypes if t == "double" and c not in ("BP", "CM") and not c.endswith(SIZES)]
    if not names:
        return {}
    got = scores.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
    return {c: got[c] for c in names if got[c]}


def restrict(scores: DataFrame, print_snps: DataFrame | None = None, cross_only: bool = False) -> DataFrame:
    """Rows of a list of ids; or only those with a score between two ancestries."""
    if print_snps is not None:
        scores = scores.join(print_snps, "SNP", "left_semi")
    if cross_only:
        cross = [c for c in scores.columns if "_" in c and not c.endswith(SIZES) and c != "snp_idx" and len(set(c.split("_", 1))) == 2]
        scores = scores.na.drop("all", subset=cross) if cross else scores
    return scores


def source_matrix(bims: dict[str, DataFrame]) -> DataFrame:
    """SNP and 0 or 1 by ancestry, from the variants that each ancestry's file lists."""
    d = reduce(lambda a, b: a.union(b), (v.select("SNP", F.lit(a).alias("ancestry")) for a, v in bims.items()))
    return d.groupBy("SNP").pivot("ancestry", sorted(bims)).agg(F.count("SNP")).select("SNP", *(F.when(F.col(a) > 0, 1).otherwise(0).alias(a) for a in sorted(bims)))
