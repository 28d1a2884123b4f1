"""One row a variant over all populations: joined on the id, alleles turned to the first population's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import same_alleles, swapped_alleles

#: What a population's statistics are kept as.
FIELDS = ("CHR", "BP", "A1", "A2", "FREQ", "BETA", "SE", "N", "P", "INFO")
#: Allow-lists up to this number of ids are broadcast.
SMALL_LIST = 1_000_000


def intersect(frames: list[DataFrame], keep: DataFrame | None = None) -> DataFrame:
    """Ids that all frames have: one shuffle of each by SNP, reused from join to join. keep: an allow-list."""
    out = reduce(lambda a, b: a.join(b.select("SNP"), "SNP", "left_semi"), frames[1:], frames[0].select("SNP").distinct())
    return semi(out, keep) if keep is not None else out


def semi(df: DataFrame, keep: DataFrame) -> DataFrame:
    ids = keep.select("SNP").distinct()
    return df.join(F.broadcast(ids) if ids.limit(SMALL_LIST + 1).count() <= SMALL_LIST else ids, "SNP", "left_semi")


def wide(pops: list[DataFrame], ld: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """SNP and structs p0, p1, ... of the populations' statistics in their order, with the LD columns as struct ld."""
    frames = [p.select("SNP", F.struct(*((F.col(c) if c in p.columns else F.lit(None).cast("double")).alias(c) for c in FIELDS)).alias(f"p{i}")) for i, p in enumerate(pops)]
    if ld is not None:
        frames.insert(0, ld.select("SNP", F.struct(*(c for c in ld.columns if c not in ("SNP", "place"))).alias("ld")))
    out = reduce(lambda a, b: a.join(b, "SNP"), frames)
    return semi(out, keep) if keep is not None else out


def statuses(w: DataFrame, n: int) -> DataFrame:
    """w with match and swap, arrays of a flag a population: alleles against those of population 0, on either strand."""
    a = lambda i: (F.col(f"p{i}.A1"), F.col(f"p{i}.A2"))
    match = F.array(*(same_alleles(*a(i), *a(0)) for i in range(n)))
    swap = F.array(*(swapped_alleles(*a(i), *a(0)) for i in range(n)))
    return w.withColumns({"match": match, "swap": swap})


def flipped(p, swap):
    """A population's statistics with the alleles the other way round where swap holds."""
    put = {
        "CHR": p["CHR"], "BP": p["BP"], "A1": F.when(swap, p["A2"]).otherwise(p["A1"]), "A2": F.when(swap, p["A1"]).otherwise(p["A2"]),
        "FREQ": F.when(swap, 1 - p["FREQ"]).otherwise(p["FREQ"]), "BETA": F.when(swap, -p["BETA"]).otherwise(p["BETA"]), "SE": p["SE"], "N": p["N"], "P": p["P"], "INFO": p["INFO"],
    }
    return F.struct(*(c.alias(k) for k, c in put.items()))


def harmonise(pops: list[DataFrame], ld: DataFrame | None = None, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(harmonised rows, all joined rows with match and swap).

    A variant goes for all populations if its alleles neither match nor swap in one. Palindromic variants, where
    allowed, swap against themselves, so all populations turn and their relative signs stay.
    """
    n = len(pops)
    w = statuses(wide(pops, ld, keep), n)
    ok = reduce(lambda a, b: a & b, (F.col("match")[i] | F.col("swap")[i] for i in range(n)))
    out = w.where(ok).select("SNP", *(["ld"] if ld is not None else []), *(flipped(F.col(f"p{i}"), F.col("swap")[i]).alias(f"p{i}") for i in range(n)))
    return out, w


def ld_column(columns: list[str], a: str, b: str) -> str:
    """The LD column of two ancestries, named in either order."""
    for name in (f"{a}_{b}", f"{b}_{a}"):
        if name in columns:
            return name
    raise ValueError(f"no LD scores of {a} and {b}")


def collate(h: DataFrame, ancestries: list[str]) -> DataFrame:
    """SNP, beta[P], se[P], ld[P * P] (row by row) and the populations' structs."""
    n = len(ancestries)
    cols = h.schema["ld"].dataType.names
    return h.select(
        "SNP",
        F.array(*(F.col(f"p{i}.BETA") for i in range(n))).alias("beta"),
        F.array(*(F.col(f"p{i}.SE") for i in range(n))).alias("se"),
        F.array(*(F.col("ld")[ld_column(cols, a, b)] for a in ancestries for b in ancestries)).alias("ld"),
        *(f"p{i}" for i in range(n)),
    )
