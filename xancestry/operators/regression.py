"""Weighted least squares with fixed coefficients, as a distributed aggregate.

The data are reduced to the triangular factor of each regression's weighted rows, partition by partition; factors of
partitions are stacked and factored again. The solution of least norm then comes from the factor alone, which holds
all columns, so any choice of fixed coefficients is solved without another pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREE, ZERO, OFF_ZERO, IDENTITY, SET_CORR = "all_unconstrained", "all_zero", "offdiag_zero", "identity", "set_corr"
#: Groups in which factors of partitions are stacked before the driver stacks those.
GROUPS = 32


def constraint(p: int, option) -> np.ndarray:
    """P x P coefficients, NaN where free."""
    if isinstance(option, str):
        free = np.full((p, p), np.nan)
        made = {FREE: free, SET_CORR: free, ZERO: np.zeros((p, p)), OFF_ZERO: np.where(np.eye(p, dtype=bool), np.nan, 0.0), IDENTITY: np.eye(p)}
        if option in made:
            return made[option]
    elif isinstance(option, np.ndarray):
        if option.shape != (p, p):
            raise ValueError(f"a matrix of {option.shape} where {p} x {p} is needed")
        return option.astype(float)
    raise ValueError(f"no such option: {type(option).__name__} {option}")


def solve(r: np.ndarray, fixed: np.ndarray, rows: int) -> np.ndarray:
    """Coefficients from the factor of [X | y]; NaN in fixed is free. Least norm where the design is deficient."""
    k = len(fixed)
    out, free = fixed.copy(), np.isnan(fixed)
    if free.any():
        y = r[:, k] - r[:, :k][:, ~free] @ fixed[~free]
        out[free] = np.linalg.lstsq(r[:, :k][:, free], y, rcond=np.finfo(float).eps * max(rows, int(free.sum())))[0]
    return out


def run_regression(y, x, fixed=None, weights=None) -> np.ndarray:
    """The same for arrays on the driver."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if weights is not None:
        weights = np.asarray(weights, float)
        if (weights < 0).any():
            raise ValueError("a negative weight")
        root = np.sqrt(weights)
        x, y = x * root[:, None], y * root
    return solve(np.column_stack((x, y)), np.full(x.shape[1], np.nan) if fixed is None else np.asarray(fixed, float), len(y))


def _factor(a: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(a, mode="r")
    return r if len(r) == a.shape[1] else np.vstack((r, np.zeros((a.shape[1] - len(r), a.shape[1]))))


def designs(beta: np.ndarray, se: np.ndarray, ld: np.ndarray):
    """(p, q, weighted [LD, 1, SE^2 | y]) of every regression of a block of variants."""
    n = beta.shape[1]
    for p in range(n):
        for q in range(p, n):
            x = ld[:, p * n + q]
            with np.errstate(divide="ignore"):
                w = np.where(x > 0, 1 / x, 0.0) if p == q else np.where(x != 0, np.abs(1 / x), 0.0)
            root = np.sqrt(w)
            yield p, q, np.column_stack((x, np.ones(len(x)), se[:, p] * se[:, q], beta[:, p] * beta[:, q])) * root[:, None]


def factors(c: DataFrame, n: int) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    """Factor of each regression and the number of variants, from beta, se and ld of collate()."""

    def run(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}
        rows = 0
        for pdf in batches:
            if not len(pdf):
                continue
            rows += len(pdf)
            for p, q, a in designs(*(np.array(pdf[k].tolist(), float) for k in ("beta", "se", "ld"))):
                acc[p, q] = _factor(np.vstack((acc[p, q], a)) if (p, q) in acc else a)
        for (p, q), r in acc.items():
            yield pd.DataFrame({"p": [p], "q": [q], "r": [r.ravel().tolist()], "rows": [rows]})

    def stack(pdf):
        ordered = sorted(map(tuple, pdf["r"]))  # whatever the order in which tasks end
        r = _factor(np.vstack([np.array(x).reshape(4, 4) for x in ordered]))
        return pd.DataFrame({"p": pdf["p"][:1], "q": pdf["q"][:1], "r": [r.ravel().tolist()], "rows": [int(pdf["rows"].sum())]})

    kind = "p int, q int, r array<double>, rows long"
    per = c.select("beta", "se", "ld").mapInPandas(run, kind)
    got = per.groupBy("p", "q", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).applyInPandas(lambda pdf: stack(pdf), kind).collect()
    out, rows = {}, 0
    for p in range(n):
        for q in range(p, n):
            own = sorted((r for r in got if (r["p"], r["q"]) == (p, q)), key=lambda r: r["r"])
            out[p, q] = _factor(np.vstack([np.array(r["r"]).reshape(4, 4) for r in own])) if own else np.zeros((4, 4))
            rows = sum(r["rows"] for r in own)
    return out, rows


def ldscore_regressions(c: DataFrame, n: int, ld=FREE, const=FREE, se2=FREE, correlation: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P x P coefficients of LD, intercept and SE^2, from one pass over the variants.

    With set_corr the off-diagonal LD coefficients are the correlation times the root of the diagonal ones' product, once
    these are known; where that has no root they stay free.
    """
    rs, rows = factors(c, n)
    fixed = [constraint(n, x) for x in (ld, const, se2)]
    out = [np.full((n, n), np.nan) for _ in range(3)]

    def put(p, q):
        got = solve(rs[p, q], np.array([f[p, q] for f in fixed]), rows)
        for m, v in zip(out, got):
            m[p, q] = m[q, p] = v

    for p in range(n):
        put(p, p)
    if isinstance(ld, str) and ld == SET_CORR:
        d = np.diag(out[0])
        with np.errstate(invalid="ignore"):
            fixed[0] = np.where(np.eye(n, dtype=bool), fixed[0], correlation * np.sqrt(np.outer(d, d)))
    for p in range(n):
        for q in range(p + 1, n):
            put(p, q)
    return tuple(out)
