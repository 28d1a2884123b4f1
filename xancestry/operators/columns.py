"""Source columns to standard ones: by pattern, one to one, with checks before anything is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PATTERNS, REQUIRED, type_of
from ..sources.text import nullify, number


class MappingError(ValueError):
    """Columns that don't map one to one, or that are missing."""


def patterns(add: dict[str, str] | None = None, replace: dict[str, str] | None = None) -> dict[str, str]:
    """The default patterns with alternatives added or replaced; each has to compile."""
    out = dict(PATTERNS)
    for name, p in (replace or {}).items():
        out[name] = p
    for name, p in (add or {}).items():
        out[name] = f"{out[name]}|{p}"
    for name, p in out.items():
        try:
            re.compile(p)
        except re.error as e:
            raise MappingError(f"the pattern of {name} doesn't compile: {e}") from e
    return out


def map_columns(columns: list[str], by: dict[str, str], required=()) -> dict[str, str]:
    """Source name -> standard name for all that match a whole pattern in any case."""
    if unknown := set(required) - set(by):
        raise MappingError(f"no pattern for required {sorted(unknown)}")
    hits = [(c, std) for c in columns for std, p in by.items() if re.fullmatch(p, c, re.IGNORECASE)]
    for k, what in ((0, "column"), (1, "standard name")):
        seen: dict[str, set] = {}
        for h in hits:
            seen.setdefault(h[k], set()).add(h[1 - k])
        if twice := {x: sorted(v) for x, v in seen.items() if len(v) > 1}:
            raise MappingError(f"more than one match for {what} {twice}")
    out = dict(hits)
    if missing := set(required) - set(out.values()):
        raise MappingError(f"no column for {sorted(missing)} among {columns}")
    return out


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns; a source that isn't there or a name taken by another column is an error."""
    if missing := set(names) - set(df.columns):
        raise MappingError(f"no column {sorted(missing)}")
    after = [names.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise MappingError(f"two columns would have one name: {sorted(c for c in after if after.count(c) > 1)}")
    return df.toDF(*after)


def typed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Standard columns with their types (text is parsed strictly), upper-case alleles and chromosomes, lower-case ids."""
    text = {n for n, t in df.dtypes if t == "string"}
    raw = {std: F.col("`" + c.replace("`", "``") + "`") for c, std in names.items()}

    def one(std):
        src = next(c for c, s in names.items() if s == std)
        c = nullify(raw[std]) if src in text else raw[std]
        if std == "SNP":
            return F.lower(c.cast("string"))
        if std in ("A1", "A2", "CHR"):
            return F.upper(c.cast("string"))
        return number(c, type_of(std)) if src in text else F.nanvl(c.cast("double"), F.lit(None).cast("double")).cast(type_of(std))

    keep = [c for c in ("place",) if c in df.columns]
    return df.select(*(one(s).alias(s) for s in names.values()), *keep)


def standardise(df: DataFrame, by: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Mapped, renamed and typed in one projection."""
    cols = [c for c in df.columns if c != "place"]
    names = names or map_columns(cols, by or PATTERNS, REQUIRED)
    rename(df, names)  # for its checks
    return typed(df, names)
