"""Results as files: one sorted text file a table, coefficients, counts."""

from __future__ import annotations

import json
import logging
import os
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _single(df: DataFrame, path: str, **options) -> None:
    """df in its order as one file of that name, on any file system."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").options(**options).csv(folder)
    Path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = Path(folder).getFileSystem(conf)
    part = fs.globStatus(Path(f"{folder}/part-*"))[0].getPath()
    fs.delete(Path(path), False)
    fs.rename(part, Path(path))
    fs.delete(Path(folder), True)


def _text(path: str, s: str) -> None:
    """A small text as the file of that name, on any file system."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(s.encode()))
    finally:
        out.close()


def write_results(df: DataFrame, path: str) -> None:
    """By chromosome as text, position and id; tab-separated, NaN for null."""
    _single(df.orderBy("CHR", "BP", "SNP"), path, sep="\t", header="true", nullValue="NaN", emptyValue="")


def write_harmonised(h: DataFrame, i: int, has_n: bool, path: str, has_info: bool = False) -> None:
    """All standard columns that the population has."""
    fields = ["CHR", "BP", "A1", "A2", *(["N"] if has_n else []), "FREQ", "BETA", "SE", "P", *(["INFO"] if has_info else [])]
    _single(h.select("SNP", *(F.col(f"p{i}.{c}").alias(c) for c in fields)).orderBy("SNP"), path, sep="\t", header="true", nullValue="NaN", emptyValue="")


def write_coefficients(m: np.ndarray, path: str) -> None:
    """Row by row on one line, tab-separated, without a newline."""
    _text(path, "\t".join(repr(float(x)) for x in m.ravel()))


def write_ldscores(scores: DataFrame, path: str) -> None:
    """path.l2.ldscore.gz with ten decimals and NA for null."""
    fixed = [F.when(F.col(c).isNotNull(), F.format_string("%.10f", F.col(c))).alias(c) for c, t in scores.dtypes if t == "double"]
    d = scores.orderBy("snp_idx").select("CHR", "SNP", "BP", *fixed)
    _single(d, f"{path}.l2.ldscore.gz", sep="\t", header="true", nullValue="NA", compression="gzip")


def write_counts(counts: DataFrame, path: str) -> None:
    """path.l2.M.json and path.l2.M_5_50.json: numbers of variants by pair of ancestries."""
    rows = counts.orderBy("anc1", "anc2").collect()
    for name, c in (("M", "m"), ("M_5_50", "m_5_50")):
        _text(f"{path}.l2.{name}.json", json.dumps({f"{r['anc1']}_{r['anc2']}": r[c] for r in rows}, indent=1))


def elapsed(seconds: float) -> str:
    """Days, hours and minutes if there are any, and seconds: 1d:2h:3m:4.5s."""
    whole, rest = divmod(seconds, 60)
    parts = []
    for unit, size in (("m", 60), ("h", 24)):
        whole, n = divmod(int(whole), size)
        parts.insert(0, f"{n}{unit}:" if n else "")
    return (f"{whole}d:" if whole else "") + "".join(parts) + f"{rest:.1f}s"


def logger(path: str | None, level: int = logging.INFO, console: bool = True) -> logging.Logger:
    """Everything to a file; with console up to INFO to standard output too. Warnings and errors go to standard error."""
    log = logging.getLogger("xancestry")
    log.setLevel(level)
    log.handlers.clear()
    out, err = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    out.addFilter(lambda r: r.levelno <= logging.INFO)
    err.setLevel(logging.WARNING)
    for h in (*([out] if console else []), err, *([logging.FileHandler(path, "w")] if path else [])):
        h.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(h)
    return log


def output_prefix(path: str) -> str:
    path = path.strip()
    if os.path.exists(path):
        raise ValueError(f"{path} is there already, as a file or folder")
    folder = os.path.dirname(path) or "."
    if not os.path.isdir(folder):
        raise ValueError(f"no folder {folder}")
    return path
