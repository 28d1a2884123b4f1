"""Delimited text: sniffed delimiters, comments that end a line anywhere, many tokens for null, strict numbers."""

from __future__ import annotations

import csv
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NULLS


class SourceError(ValueError):
    """A source that can't be read as what it should be."""


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, in order, on any file system; none is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    files = sorted(f.getPath().toString() for f in found or [])
    if not files:
        raise SourceError(f"no file matches {pattern}")
    return files


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (column value) without comments and blank ones, with their place in the input (column place).

    Compression is by the file's suffix. The place orders lines as the file does.
    """
    raw = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return raw.select(F.regexp_replace("value", "#.*$", "").alias("value"), place.alias("place")).where("trim(value) <> ''")


def sniff(text: str) -> str:
    """The delimiter of a header line, as a regular expression for split."""
    if "\t" in text:
        return "\t"
    try:
        found = csv.Sniffer().sniff(text, delimiters=",;| ").delimiter
    except csv.Error:
        return r"\s+"
    return r"\s+" if found == " " else found


def header(spark: SparkSession, path: str, sep: str | None = None) -> list[str]:
    """Column names from the first line that counts; one line is read."""
    first = lines(spark, path).select("value").head(1)
    if not first:
        raise SourceError(f"{path} has no header")
    line = first[0]["value"].strip()
    sep = sep or sniff(line)
    return re.split(sep if sep == r"\s+" else re.escape(sep), line)


def nullify(c):
    """NULL for every token that means it."""
    return F.when(~F.trim(c).isin(*NULLS), F.trim(c))


def scan(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A table of strings, null where a token means it; column place keeps the file's order."""
    top = lines(spark, path).head(1)
    if not top:
        raise SourceError(f"{path} has no header")
    sep = sep or sniff(top[0]["value"])
    cut = sep if sep == r"\s+" else re.escape(sep)
    names = re.split(cut, top[0]["value"].strip(" \r\n") if sep != r"\s+" else top[0]["value"].strip())
    at = top[0]["place"]
    is_body = (F.col("place.f") != at["f"]) | (F.col("place.b") != at["b"]) | (F.col("place.i") != at["i"])
    # The header's text is nulled besides, as strict casts may be moved before the filter.
    body = lines(spark, path).where(is_body).withColumn("value", F.when(is_body, F.col("value")))
    value = F.trim("value") if sep == r"\s+" else F.regexp_replace("value", "\r$", "")
    parts = F.split(value, cut)
    return body.select(*(nullify(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)), "place")


def obtain(spark: SparkSession, source, sep: str | None = None) -> DataFrame:
    """A DataFrame of Spark or pandas as it is, or the table at a path; anything else is refused."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return scan(spark, source, sep)
    if type(source).__module__.split(".")[0] == "pandas":
        return spark.createDataFrame(source)
    raise SourceError(f"a path or a DataFrame is needed, not {type(source).__name__}")


def number(c, kind: T.DataType):
    """A strict cast: null stays null, and text that is no number fails the query instead of turning null."""
    got = c.try_cast(kind) if not isinstance(kind, T.LongType) else c.try_cast(T.DoubleType()).try_cast(T.LongType())
    got = F.nanvl(got, F.lit(None).cast(kind)) if isinstance(kind, T.DoubleType) else got
    wrong = c.isNotNull() & got.isNull() & ~F.lower(F.trim(c.cast("string"))).isin("nan", "-nan", "+nan")
    return F.when(wrong, F.raise_error(F.concat(F.lit("no number: "), c.cast("string"))).cast(kind)).otherwise(got)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ; gaps are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, as column SNP, in the case that the file has."""
    return lines(spark, path).select(F.trim("value").alias("SNP"))


def one_column(spark: SparkSession, path: str) -> DataFrame:
    """As ids(), of a file that has one column; more are an error."""
    d = ids(spark, path)
    if wide := d.where(F.size(F.split("SNP", r"\s+")) > 1).head(1):
        raise SourceError(f"{path} has more than one column: {wide[0]['SNP']!r}")
    return d


def matrix(path: str, size: int) -> np.ndarray:
    """size * size numbers, tab-separated, row by row, from a small file."""
    rows = SparkSession.active().read.text(path, wholetext=True).collect()
    got = np.array([float(x) for r in rows for x in r["value"].split()])
    if got.size != size * size:
        raise SourceError(f"{path} has {got.size} numbers instead of {size * size}")
    return got.reshape(size, size)
