"""Quality filters of summary statistics: all judged on the same rows, counted one by one, in a single pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.expressions import complement
from ..schema import BASES, CHROMOSOMES, FREQUENCIES, REQUIRED

#: A filter tells of each row whether it has to go.
Filter = Callable[[DataFrame], Column]


def _null_is(c: Column, drop: bool) -> Column:
    return F.coalesce(c, F.lit(drop))


def no_nan(df: DataFrame) -> Column:
    """A required column is null."""
    return F.greatest(*(F.col(c).isNull() for c in REQUIRED))


def freq_bounds(low: float, high: float) -> Filter:
    if low > high:
        raise ValueError(f"frequency bounds {low} and {high} are the wrong way round")
    return lambda df: _null_is(~F.col("FREQ").between(low, high), True)


def chr_values(allowed) -> Filter:
    allowed = [str(c).upper() for c in allowed]
    return lambda df: _null_is(~F.col("CHR").isin(allowed), True) if allowed else F.lit(True)


def filters(freq=FREQUENCIES, chromosomes=CHROMOSOMES, palindromic: bool = False) -> dict[str, tuple[Filter, str]]:
    """The registry: name -> (filter, what it drops). palindromic: such variants may stay."""
    single = list(BASES)
    out = {
        "NO NAN": (no_nan, "rows with a null in a required column"),
        "FREQ BOUNDS": (freq_bounds(*freq), f"frequencies outside {freq[0]} to {freq[1]}"),
        "SE BOUNDS": (lambda df: _null_is(F.col("SE") <= 0, False), "standard errors that aren't positive"),
        "CHR VALUES": (chr_values(chromosomes), f"chromosomes other than {list(chromosomes)}"),
        "DUPLICATE ALLELE SNPS": (lambda df: _null_is(F.col("A1") == F.col("A2"), False), "equal alleles"),
        "PALINDROMIC SNPS": (lambda df: _null_is(complement(F.col("A1")) == F.col("A2"), False), "alleles that are each other's complement"),
        "INVALID ALLELES": (lambda df: _null_is(~F.col("A1").isin(single) | ~F.col("A2").isin(single), True), "alleles other than single bases"),
        "NEGATIVE GWAS P": (lambda df: _null_is(F.col("P") < 0, False), "negative P-values"),
    }
    if palindromic:
        del out["PALINDROMIC SNPS"]
    return out


def _some(df: DataFrame, most: int) -> list[str]:
    got = [r[0] for r in df.select("SNP").limit(most + 1).collect()]
    return [*got[:most], "..."] if len(got) > most else got


@dataclass
class Checked:
    """Rows that pass, and every row with its flags (columns of `flags` by filter name); optional filters that can't be resolved are None."""

    passed: DataFrame
    flagged: DataFrame
    flags: dict[str, str | None]
    duplicates: DataFrame | None = None

    def metrics(self) -> DataFrame:
        """One row a filter with the number of rows that it drops, then ANY and TOTAL; one pass, partial counts first."""
        named = [(n, c) for n, c in self.flags.items() if c]
        got = self.flagged.agg(*(F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(named)), F.count_if("drop_any").alias("any_"), F.count("*").alias("total"))
        rows = [F.struct(F.lit(n).alias("filter"), F.col(f"n{i}").alias("dropped")) for i, (n, _) in enumerate(named)]
        rows += [F.struct(F.lit("ANY").alias("filter"), F.col("any_").alias("dropped")), F.struct(F.lit("TOTAL").alias("filter"), F.col("total").alias("dropped"))]
        return got.select(F.explode(F.array(*rows)).alias("m")).select("m.*")

    def dropped(self, name: str, most: int = 50) -> list[str]:
        """Ids that a filter drops, for a log: `most` of them, and "..." if there are more."""
        return _some(self.flagged.where(self.flags[name]), most)

    def repeated(self, most: int = 50) -> list[str]:
        """The same of rows that go as duplicates."""
        return _some(self.duplicates, most) if self.duplicates is not None else []


def run_filters(df: DataFrame, required: dict[str, tuple[Filter, str]], optional: dict[str, tuple[Filter, str]] | None = None) -> Checked:
    """Every filter on the unfiltered rows; a required one that fails is an error, an optional one counts as None."""
    flags: dict[str, str | None] = {}
    cols: dict[str, Column] = {}
    for i, (name, (f, _)) in enumerate([*required.items(), *(optional or {}).items()]):
        try:
            c = f(df)
            df.select(c)
        except (AnalysisException, KeyError, ValueError, TypeError):
            if name in required:
                raise
            flags[name] = None
            continue
        flags[name] = f"drop_{i}"
        cols[f"drop_{i}"] = c
    flagged = df.withColumns(cols) if cols else df
    flagged = flagged.withColumn("drop_any", F.greatest(F.lit(False), F.lit(False), *map(F.col, cols)))
    # The rows that pass come straight from df: without the flags' names, plans of many populations stay small.
    return Checked(df.where(~F.greatest(F.lit(False), F.lit(False), *cols.values())), flagged, flags)


def first_of_each(df: DataFrame, order: str = "place") -> tuple[DataFrame, DataFrame]:
    """Rows that come first of their SNP in file order, and the duplicates that go.

    One window by SNP, which sends and sorts each row once: a variant has few copies.
    """
    n = F.row_number().over(Window.partitionBy("SNP").orderBy(order))
    numbered = df.withColumn("copy_", n)
    return numbered.where("copy_ = 1").drop("copy_"), numbered.where("copy_ > 1").drop("copy_")


def qc_sumstats(df: DataFrame, by: dict | None = None, optional: dict | None = None, order: str = "place") -> Checked:
    """Filters, then the first row of each SNP."""
    out = run_filters(df, by if by is not None else filters(), optional)
    if order not in df.columns:
        out.passed = out.passed.withColumn(order, F.monotonically_increasing_id())
    out.passed, out.duplicates = first_of_each(out.passed, order)
    return out


def qc_ldscores(df: DataFrame) -> DataFrame:
    """Lower-case ids, and no row with a null in any column."""
    rest = [c for c in df.columns if c not in ("SNP", "place")]
    text = {c for c, t in df.dtypes if t == "string"}
    from ..sources.text import number
    from pyspark.sql import types as T

    keys = {"CHR", "A1", "A2"}
    cols = [F.col(c) if c in keys or c not in text else number(F.col(c), T.DoubleType()) for c in rest]
    cols = [F.when(F.isnan(c), None).otherwise(c) if dict(df.dtypes)[n] in ("double", "float") else c for c, n in zip(cols, rest)]
    return df.select(F.lower("SNP").alias("SNP"), *(c.alias(n) for c, n in zip(cols, rest))).na.drop("any")
